"""Brute-force versions of the training-data operators: plain Python, on small inputs, sharing no code with them."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

UPPER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RUN = re.compile(r"[^\x20\x09-\x0D]+")


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def low_words(text):
    return WORD.findall((text or "").translate(UPPER))


def windows(words, size=10):
    if len(words) < size:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


def contamination(docs, items, size=10):
    """doc_id -> (n_words, n_hit, n_items, sha256, contaminated), for unique doc ids."""
    grams = defaultdict(set)
    for item, text in items:
        for g in windows(low_words(text), size):
            grams[g].add(str(item))
    sizes = sorted({len(g) for g in grams})
    out = {}
    for doc, text in docs:
        w = low_words(text)
        hit, found = set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (g := tuple(w[i : i + k])) in grams:
                    hit.update(range(i, i + k))
                    found |= grams[g]
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    text = text or ""
    w = RUN.findall(text)
    lines = [x for x in text.split("\n") if RUN.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def shingles(text):
    w = low_words(text)
    return frozenset(windows(w, 5))


def jaccard_classes(docs, threshold=0.8):
    """doc_id -> (smallest doc_id of the class, class size, links to other documents), for unique doc ids."""
    sets = {d: shingles(t) for d, t in docs}
    holders = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    common = Counter()
    for ds in holders.values():
        common.update(itertools.combinations(sorted(ds), 2))
    links = [p for p, n in common.items() if n >= threshold * (len(sets[p[0]]) + len(sets[p[1]]) - n) - 1e-9]
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    n_links = Counter()
    for a, b in links:
        n_links[a] += 1
        n_links[b] += 1
        a, b = sorted((find(a), find(b)))
        root[b] = a
    size = Counter(find(d) for d in sets)
    return {d: (find(d), size[find(d)], n_links[d]) for d in sets}


def spread_lines(docs):
    """docs: (doc_id, site, text). The line -> keeping doc_id of every line on 10 sites, or on 3 if it has 20 words."""
    sites, keeper = defaultdict(set), {}
    for d, site, text in docs:
        for line in set((text or "").split("\n")) if text is not None else ():
            if RUN.search(line):
                sites[line].add(site or "")
                keeper[line] = min(d, keeper.get(line, d))
    return {x: keeper[x] for x, s in sites.items() if len(s) >= (3 if len(RUN.findall(x)) >= 20 else 10)}


def without_lines(docs):
    """doc_id -> text without boilerplate lines."""
    gone = spread_lines(docs)
    return {d: None if text is None else "\n".join(x for x in text.split("\n") if gone.get(x, d) == d) for d, _, text in docs}


def tokens(text):
    return [*RUN.findall((text or "").translate(UPPER)), None]


def unigram_base(docs, held):
    """doc_id -> (n_tokens, n_known, train_tokens, base_score)."""
    c = Counter(t for d, text in docs if not held(d) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    out = {}
    for d, text in docs:
        ts = tokens(text)
        out[d] = len(ts), sum(c[t] > 0 for t in ts), n, sum(math.log10((c[t] + 1) / (n + 1 * (v + 1))) for t in ts)
    return out


def text_density(chars, tags, link_chars, link_tags, body_links):
    """Composite text density of one element, from the published formula with the shifted base."""
    if chars == 0:
        return 0.0
    tags, links, link_tags = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + body_links * chars + math.e) + math.e - 1
    return chars / tags * max(0.0, math.log((chars / links) * (tags / link_tags), base))


class _Page(HTMLParser):
    """Lines of visible text, links and title of a page, event by event."""

    BREAKS = set("html head body p div br h1 h2 h3 article nav footer ul li meta".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.links, self.title, self.inside = [""], [], "", []

    def handle_starttag(self, tag, attrs):
        if tag in self.BREAKS:
            self.lines.append("")
        if tag in ("script", "style", "title"):
            self.inside.append(tag)
        if tag == "a" and dict(attrs).get("href") is not None:
            self.links.append(dict(attrs)["href"])

    def handle_endtag(self, tag):
        if tag in self.BREAKS:
            self.lines.append("")
        if self.inside and self.inside[-1] == tag:
            self.inside.pop()

    def handle_data(self, data):
        if "title" in self.inside:
            self.title += data
        if not self.inside:
            self.lines[-1] += data


def page_lines(html):
    page = _Page()
    page.feed(html)
    page.close()
    return [x for x in (" ".join(x.split()) for x in page.lines) if x], page.links, " ".join(page.title.split())


class Trigrams:
    """A trigram model of some texts, counted token by token."""

    def __init__(self, texts):
        self.grams, self.contexts = Counter(), Counter()
        for text in texts:
            for a, b, w in self.events(text):
                self.grams.update([(w,), (b, w), (a, b, w)])
                self.contexts.update([(b,), (a, b)])
        self.n, self.v = sum(c for g, c in self.grams.items() if len(g) == 1), sum(len(g) == 1 for g in self.grams)

    def without(self, text):
        """The same model with the counts of one of its texts deleted; its distinct words stay."""
        out, own = Trigrams([]), Trigrams([text])
        out.grams, out.contexts, out.n, out.v = self.grams - own.grams, self.contexts - own.contexts, self.n - own.n, self.v
        return out

    @staticmethod
    def events(text):
        ts = [None, None, *tokens(text)]
        return zip(ts, ts[1:], ts[2:], strict=False)

    def parts(self, a, b, w):
        """(level, bucket) of the longest context seen, and the four estimates."""
        c3, c2 = self.contexts[a, b], self.contexts[(b,)]
        level, c = (2, c3) if c3 else (1, c2) if c2 else (0, 0)
        f = [self.grams[a, b, w] / c3 if c3 else 0, self.grams[b, w] / c2 if c2 else 0, self.grams[(w,)] / max(self.n, 1), 1 / (self.v + 1)]
        return (level, c if c <= 4 else 1 + c.bit_length()), f

    def p(self, a, b, w, weights):
        where, f = self.parts(a, b, w)
        return sum(x * y for x, y in zip(weights(*where), f, strict=True))

    def score(self, text, weights):
        return sum(math.log10(self.p(a, b, w, weights)) for a, b, w in self.events(text))

    def learned(self, texts, rounds=100):
        events = [self.parts(*e) for t in texts for e in self.events(t)]
        may = lambda level: [level == 2, level >= 1, True, True]
        w = defaultdict(list)
        for where, _ in events:
            w[where] = [x / sum(may(where[0])) for x in may(where[0])]
        for _ in range(rounds):
            new = {where: [0.1 * x for x in may(where[0])] for where in w}
            for where, f in events:
                share = [x * y for x, y in zip(w[where], f, strict=True)]
                for j in range(4):
                    new[where][j] += share[j] / sum(share)
            w = {k: [x / sum(v) for x in v] for k, v in new.items()}
        return lambda level, size: w[level, size]


def linked_components(docs, num=85, den=100):
    """doc_id -> (set size, smallest doc_id reachable), for unique doc ids: five-word shingles of blank-separated words."""
    sets = {}
    for d, text in docs:
        w = RUN.findall((text or "").translate(UPPER))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    holders = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    common = Counter()
    for ds in holders.values():
        common.update(itertools.combinations(sorted(ds), 2))
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in common.items():
        if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {d: (len(s), find(d)) for d, s in sets.items()}


def conversation_repair(rows):
    """rows: (conv_id, turn, role, text). conv_id -> the contract's columns, by a search over all cheapest edits in plain order."""
    groups = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        groups[c]
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        groups[c] += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    out = {}
    for c, g in groups.items():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        kinds, seen = [], set()
        for _, role, text in g:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            kinds.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in g if t is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(g)]
        # cheapest (cost, audit) to each grammar place of what was written, row by row; up to three inserts before each row and at the end
        best = {"": (0, "", ())}

        def follow(place, initial):
            return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((place, initial))

        def offer(table, place, entry):
            if place is not None and (place not in table or entry[:2] < table[place][:2]):
                table[place] = entry

        def inserted(table):
            for _ in range(6):
                for place, (cost, audit, text) in list(table.items()):
                    for role in ("user", "assistant"):
                        offer(table, follow(place, role[0]), (cost + 2, audit + "I", (*text, f"{role}:")))
            return table

        for (_, role, text), kind in zip(g, kinds, strict=True):
            after = {}
            for place, (cost, audit, done) in inserted(best).items():
                offer(after, place, (cost + 3, audit + "D", done))
                if kind not in ("b", "d"):
                    more = kind == "t"
                    offer(after, follow(place, role[:1]), (cost + more, audit + "K", (*done, f"{role}:{text}")))
                    for new in ("user", "assistant"):
                        offer(after, follow(place, new[0]), (cost + 2 + more, audit + "R", (*done, f"{new}:{text}")))
            best = after
        cost, audit, done = min((e for p, e in inserted(best).items() if p in ("", "a")), key=lambda e: e[:2])
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, kinds.count("b"), kinds.count("d"), kinds.count("t"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest())
    return out
