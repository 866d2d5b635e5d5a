"""Plain-Python model of fit and search, used as the expected result on small data."""

from collections import Counter, defaultdict


def l1(a, b):
    return sum(abs(x - y) for x, y in zip(a, b))


def descend(v, levels, k):
    cell = 0
    for centers in levels:
        cell = min(range(cell * k, cell * k + k), key=lambda c: (l1(v, centers[c]), c))
    return cell


def seeds(points, levels, k):
    found = defaultdict(list)
    for _, _, v in sorted(points, key=lambda p: p[:2]):
        mine = found[descend(v, levels, k)]
        if len(mine) < k and v not in mine:
            mine.append(v)
    return [v for parent in sorted(found) for v in found[parent]]


def fit(points, k, depth, iterations):
    levels = []
    for level in range(depth):
        centers = seeds(points, levels, k)
        if len(centers) < k ** (level + 1):
            break
        for _ in range(iterations):
            members = defaultdict(list)
            for _, _, v in points:
                members[descend(v, [*levels, centers], k)].append(v)
            centers = [
                [sum(col) // len(members[c]) for col in zip(*members[c])] if c in members else centers[c]
                for c in range(len(centers))
            ]
        levels.append(centers)
    return levels


def vote_cut(candidates, limit):
    """candidates (dist, image) of one descriptor -> images, by whole distance groups."""
    groups = defaultdict(list)
    for dist, image in candidates:
        groups[dist].append(image)
    count, out = 0, set()
    for dist in sorted(groups):
        count += len(groups[dist])
        out.update(groups[dist])
        if count > limit:
            break
    return out


def search(points, queries, levels, k, limit, top=10):
    """queries (query_id, desc_no, v) -> rows (query_id, rank, image, votes)."""
    by_leaf = defaultdict(list)
    for image, _, v in points:
        by_leaf[descend(v, levels, k)].append((image, v))
    counts = defaultdict(Counter)
    for query, _, v in queries:
        near = [(l1(v, w), image) for image, w in by_leaf[descend(v, levels, k)]]
        for image in vote_cut(near, limit):
            counts[query][image] += 1
    rows = []
    for query, votes in counts.items():
        ranked = sorted(((-n, image) for image, n in votes.items() if n > 1))[:top]
        rows += [(query, rank, image, -n) for rank, (n, image) in enumerate(ranked, 1)]
    return sorted(rows)
