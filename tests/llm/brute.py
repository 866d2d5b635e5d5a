"""Plain versions of the operators' results, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
NORMAL_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def decontamination(docs, items, n=10):
    """docs, items: (id, text) rows -> rows of op2."""
    windows = defaultdict(set)
    for item, text in items:
        words = NORMAL_WORDS.findall(lower(text))
        if words:
            size = min(n, len(words))
            for i in range(len(words) - size + 1):
                windows[tuple(words[i : i + size])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        words, hit, found = NORMAL_WORDS.findall(lower(text)), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                items_in = windows.get(tuple(words[i : i + size]))
                if items_in:
                    hit.update(range(i, i + size))
                    found |= items_in
        named = sorted(str(i) for i in found if i is not None)
        digest = hashlib.sha256(",".join(named).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(named), digest, bool(hit)))
    return out


def base_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    words = WORDS.findall(text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    under = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            under.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    failed = n < 10 or 100 * len(under) > 20 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(under), failed


def shards(docs, count=16):
    """(doc_id, size, crc, shard, slot) in the order of (md5 of the text, doc_id)."""
    rows = sorted(
        (hashlib.md5((t or "").encode()).hexdigest(), d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
        for d, t in docs
    )
    total, before, out, slots = sum(r[2] for r in rows), 0, [], Counter()
    for _, doc, size, crc in rows:
        shard = (2 * before + size) * count // (2 * total)
        out.append((doc, size, crc, shard, slots[shard]))
        slots[shard] += 1
        before += size
    return sorted(out)


def shingles(text, n=5):
    words = WORDS.findall(lower(text))
    if not words:
        return frozenset()
    if len(words) < n:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def near_duplicates(docs, percent=85):
    """(doc_id, n_shingles, component_id, kept) by comparing every pair that shares a shingle."""
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            parent[d] = parent[parent[d]]
            d = parent[d]
        return d

    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    shared = Counter()
    for ds in holders.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                shared[a, b] += 1
    for (a, b), both in shared.items():
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            ra, rb = sorted((root(a), root(b)))
            parent[rb] = ra
    return sorted((d, len(s), root(d), root(d) == d) for d, s in sets.items())


def repeats(docs, n=50):
    """{doc_id: (repeated word positions, later word positions)} over windows of n words.

    The first place of a window is that of the smallest (doc_id, position).
    """
    places = defaultdict(list)
    for d, text in docs:
        words = WORDS.findall(text or "")
        for i in range(len(words) - n + 1):
            places[tuple(words[i : i + n])].append((d, i))
    out = defaultdict(lambda: (set(), set()))
    for where in places.values():
        if len(where) > 1:
            first = min(where)
            for d, i in where:
                out[d][0].update(range(i, i + n))
                if (d, i) != first:
                    out[d][1].update(range(i, i + n))
    return dict(out)


def rule(url):
    """(host, path, rule, verdict or None)."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = lower(host)
    best = (None, None)
    for verdict, h, p in [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]:
        fits = (host == h or host.endswith("." + h)) and path.startswith(p)
        if fits and (best[0] is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, *best


def article(html):
    """Main text of the driver's pages, by their template: the article's h1 and p."""
    from html import unescape

    html = html or ""
    start = html.find("<article>")
    if start < 0:
        return ""
    body = html[start:].split("</article>")[0].split("<footer>")[0]
    blocks = re.split(r"</?(?:article|h1|p|div)[^>]*>", body)
    texts = [" ".join(unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in blocks]
    return "\n\n".join(t for t in texts if t)
