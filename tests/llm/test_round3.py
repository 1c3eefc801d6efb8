"""Whitening, conversation repair and circulant MinHash against brute force, and their edge cases."""

import itertools
import random
import re
import time

import brute as B
import numpy as np
import pandas as pd
import pytest

from basisline.llm import circulant, conversations, dom, html_extraction, line_dedup, near_duplicates, whitening
from basisline.llm import shingles as sh
from basisline.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<float>, label int, x string, n string"


def integral(v):
    return [[int(np.floor(256.0 * float(c))) for c in row] for row in v]


def check_whitening(out, rows, k=4):
    """out: result rows; rows: usable (vec_id, embedding). All columns against plain numpy and Python."""
    x = integral(v for _, v in rows)
    distinct = sorted({tuple(v) for v in x})
    n, d = len(distinct), len(distinct[0])
    sums = [sum(v[j] for v in distinct) for j in range(d)]
    a = np.asarray(distinct, "float64")
    mean = np.asarray([s / n for s in sums])
    e, q = np.linalg.eigh((a - mean).T @ (a - mean) / n)
    e, q = e[::-1], q[:, ::-1]
    deviation = {tuple(v): sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in distinct}
    want = sorted((str(i), deviation[tuple(v)]) for (i, _), v in zip(rows, x, strict=True))
    for comp in range(1, min(k, d) + 1):
        part = out[out.component == comp]
        assert sorted((str(i), v) for i, v in zip(part.vec_id, part.deviation, strict=True)) == want
        assert np.allclose(part.explained, e[comp - 1] / e.sum(), rtol=1e-9, atol=1e-14)
        if e[comp - 1] > 1e-9:
            mine = dict(zip(part.vec_id, part.whitened, strict=True))
            theirs = {i: (np.asarray(v, "float64") - mean) @ q[:, comp - 1] / np.sqrt(e[comp - 1]) for (i, _), v in zip(rows, x, strict=True)}
            ids = list(mine)
            m, t = np.asarray([mine[i] for i in ids]), np.asarray([theirs[i] for i in ids])
            assert min(np.abs(m - t).max(), np.abs(m + t).max()) < 1e-7
    assert (out.n == n).all() and (out.identity_error < 1e-9).all() and len(out) == len(rows) * min(k, d)


def test_whitening_equals_brute_force(spark, sf):
    e = pd.read_parquet(f"{sf}/embeddings.parquet")
    check_whitening(QUERIES["op11_svd_merge_whitening"](spark, sf).toPandas(), list(zip(e.vec_id, e.embedding, strict=True)))


def test_whitening_merges_without_loss(spark):
    """Many partitions, a far mean, fewer vectors than dimensions in a partition, repeated vectors, ties and unusable rows."""
    rng = np.random.default_rng(5)
    good = [(i, (1000 + rng.normal(size=6) * [5, 4, 3, 2, 1, 0.5]).astype("float32").tolist()) for i in range(150)]
    good += [(i + 1000, v) for i, v in good[:40]] * 2
    bad = [(1, None), (2, []), (3, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (4, [float("nan")] * 6), (5, [float("inf")] + [0.0] * 5), (None, None), (6, [1.0, 2.0])]
    rows = [(i, v, None, "a", "b") for i, v in good + bad]
    df = spark.createDataFrame(rows, VECTORS).repartition(23)
    points = whitening.integral(df, "vec_id", "embedding")
    spread = points.select("x").distinct().repartition(40)
    state = whitening.merged_states(whitening.partition_states(spread))
    assert state.n == 150 and len(state.singular) == 6
    check_whitening(whitening.whitened_components(df).toPandas(), good)


def test_whitening_without_variance_or_rows(spark):
    same = spark.createDataFrame([(i, [0.5, 0.25], None, "", "") for i in (1, 1, None)], VECTORS)
    out = whitening.whitened_components(same).toPandas()
    assert len(out) == 6 and out.whitened.isna().all() and (out.explained == 0).all() and (out.deviation == 0).all() and (out.identity_error == 0).all()
    assert whitening.whitened_components(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whitened_components(spark.createDataFrame([(1, [float("nan")], 1, "", "")], VECTORS)).count() == 0
    two = whitening.whitened_components(spark.createDataFrame([(1, [0.0, 0.0, 0.0], 1, "", ""), (2, [1.0, 0.0, 0.0], 1, "", "")], VECTORS)).toPandas()
    assert sorted(two[two.component == 1].whitened.abs()) == [1.0, 1.0] and two[two.component > 1].whitened.isna().all()


def test_deviation_beyond_64_bits():
    x = np.asarray([[3 * 10**9, -5], [1, 2]], "int64")
    sums = (10**15, 7)
    assert whitening.deviations(x, 10**6, sums) == [sum((10**6 * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x.tolist()]


TURNS = "conv_id long, turn long, role string, text string, g1 string, pos long, segment long"


def repair_frame(spark, rows):
    return spark.createDataFrame([(*r, "g", 0, 0) for r in rows], TURNS)


def as_dict(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_conversation_repair_equals_brute_force(spark, sf):
    c = pd.read_parquet(f"{sf}/conversations.parquet")
    assert as_dict(QUERIES["op12_dial_conversation_repair"](spark, sf)) == B.conversation_repair(list(zip(c.conv_id, c.turn, c.role, c.text, strict=True)))


def random_turns(rng, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "ugly", "User", "a"]
    texts = ["One. ", "Two", "Three?", "", " \t\n", None, "Four!\r\n", "five \v", "é文.", "x" * 5000]
    return [(None if rng.random() < 0.05 else t if rng.random() < 0.8 else rng.randrange(n), rng.choice(roles[: rng.choice([2, 4, 11])]), rng.choice([*texts, f"t{t}.", f"t{t}."])) for t in range(n)]


def test_conversation_repair_of_odd_rows(spark):
    rng = random.Random(8)
    rows = [(c if c else None, *r) for c in range(160) for r in random_turns(rng, rng.randrange(1, 12))]
    rows += rows[:50]
    assert as_dict(conversations.repaired(conversations.damaged(repair_frame(spark, rows).repartition(5)))) == B.conversation_repair(rows)
    assert conversations.repaired(conversations.damaged(repair_frame(spark, []))).count() == 0


def test_long_conversations_by_segments(spark, monkeypatch):
    """Every conversation over six rows goes through segments of four rows; one holds most rows, one has a row many times."""
    monkeypatch.setattr(conversations, "SEGMENT_BITS", 2)
    rng = random.Random(9)
    rows = [(c if c else None, *r) for c in range(40) for r in random_turns(rng, rng.randrange(1, 30))]
    rows += [(77, *r) for r in random_turns(rng, 600)] + [(78, 3, "user", "same.")] * 100 + [(79, 4, None, None)] * 30
    dropped = next(t for t in range(1000) if B.zlib.crc32(f"90:{t}".encode()) % 20 == 0)
    rows += [(90, dropped, "user", "gone.")] * 9
    assert as_dict(conversations.repaired(conversations.damaged(repair_frame(spark, rows)), 6)) == B.conversation_repair(rows)


def test_dial_settles_every_node_at_its_distance():
    rng = random.Random(3)
    for _ in range(200):
        turns, *_ = conversations.turns_of(*zip(*[(rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b", "", f"{i}."]), 0) for i in range(rng.randrange(1, 9))], strict=True))
        found = conversations.distances(turns, [(0, 0), (3, 0)])
        want = [[conversations.INF] * 4 for _ in range(len(turns) + 1)]  # relaxed until nothing changes
        want[-1][0] = want[-1][3] = 0
        for _ in range(12 * len(turns)):
            for i, q in itertools.product(range(len(turns) + 1), range(4)):
                w = conversations.WRITTEN[q]
                arcs = [2 + want[i][w]]
                if i < len(turns):
                    t = turns[i]
                    arcs.append(3 + want[i + 1][q])
                    if not t.forced:
                        arcs.append(2 + t.truncated + want[i + 1][w])
                        if t.initial in conversations.STEP[q]:
                            arcs.append(t.truncated + want[i + 1][conversations.STEP[q][t.initial]])
                want[i][q] = min(want[i][q], *arcs)
        assert found == want


SCHEMA = "doc_id long, text string, node string, label string, key long"


def component_rows(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_circulant_components_equal_brute_force(spark, sf):
    d = pd.read_parquet(f"{sf}/documents.parquet")
    out = QUERIES["op13_circulant_minhash"](spark, sf)
    assert component_rows(out) == B.linked_components(list(zip(d.doc_id, d.text, strict=True)))
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.collect())


def varied(rng, base, edits):
    words = list(base)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def test_circulant_components_of_near_copies(spark, monkeypatch):
    """Chains of versions, versions of one original, groups close to the threshold and copies, in blocks of eight nodes."""
    monkeypatch.setattr(circulant, "PIVOT_BLOCK", 8)
    monkeypatch.setattr(near_duplicates.in_blocks, "__defaults__", ("node", 8))
    rng, texts = random.Random(4), []
    for size in (60, 150, 400):
        base = [f"w{rng.randrange(3000)}" for _ in range(size)]
        texts += [varied(rng, base, k) for k in (0, 1, 1, 2, 3, 4, 6, 9) for _ in range(6)]
        chain = base
        for _ in range(40):
            chain = varied(rng, chain, max(1, size // 150)).split()
            texts.append(" ".join(chain))
    texts += texts[:30] + ["Same TEXT here in Five words", "same text here in five words", "one two", "ONE two", "two one", "", " \n", None]
    rng.shuffle(texts)
    rows = [(i, t, "n", "l", 1) for i, t in enumerate(texts)]
    out = circulant.linked_components(spark.createDataFrame(rows, SCHEMA).repartition(6))
    assert component_rows(out) == B.linked_components([r[:2] for r in rows])


def test_circulant_null_keys_and_repeats(spark):
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    rows = [(None, "a b c d e f g"), (None, "a b c d e f g"), (7, "a b c d e f g"), (7, "a b c d e f g"), (None, "alone in the whole table"), (3, long), (2, long + " end"), (9, None), (9, "")]
    out = circulant.linked_components(spark.createDataFrame([(*r, "", "", 0) for r in rows], SCHEMA))
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in out.collect()), key=str)
    n = len({tuple(long.split()[i : i + 5]) for i in range(29_996)})
    assert got == sorted([(True, 0, 3, 7, False)] * 2 + [(False, 7, 3, 7, True)] * 2 + [(True, 0, 1, None, True), (False, 3, n, 2, False), (False, 2, n + 1, 2, True)] + [(False, 9, 0, 9, True)] * 2, key=str)
    assert circulant.linked_components(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("similarity", [0.3, 0.6, 0.85])
def test_circulant_signature_estimates_similarity(similarity):
    """Values are evenly spread and two signatures agree as often as the sets do, with no more scatter than independent hashes."""
    rng, found = np.random.default_rng(11), []
    for _ in range(150):
        n = 400
        common = round(2 * n * similarity / (1 + similarity))
        v = rng.integers(0, 1 << 63, 2 * n - common, dtype="uint64")
        found.append((circulant.signature(v[:n]) == circulant.signature(v[n - common :])).mean())
    true = common / (2 * n - common)
    sd = (true * (1 - true) / circulant.VALUES) ** 0.5
    assert abs(np.mean(found) - true) < 4 * sd / 150**0.5 and np.std(found) < 1.25 * sd
    assert circulant.signature(np.arange(1, 10, dtype="uint64")).shape == (circulant.VALUES,)
    assert len(np.unique(sh.mix(np.arange(100_000, dtype="uint64") * circulant._FIRST))) == 100_000


def test_least_matches_bound_the_loss():
    from math import comb

    m = circulant.least_matches()
    tail = lambda k: sum(comb(circulant.VALUES, i) * 0.85**i * 0.15 ** (circulant.VALUES - i) for i in range(k))
    assert tail(m) <= circulant.MISS < tail(m + 1)


def regex_tags(html):
    """The tags of a page by one backtracking pattern, for short pages."""
    token = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
    return [(m.start(), m.end(), bool(m[1] or m[4]), (m[2] or m[5] or "").lower(), m[3] or m[6] or "") for m in token.finditer(html)]


def test_tags_equal_a_pattern_on_broken_pages():
    rng = random.Random(12)
    parts = ["<a x=", "<a x=\"", "'", "\"", ">", "<b>", "</b>", "<!--", "-->", "<!d", "<?", "text", " ", "<", "</", "/", "<p class='c'>", "=", "<a<b", "\n"]
    for _ in range(4000):
        html = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
        found, pos, tokens = [], 0, dom.Tokens(html)
        while t := tokens.after(pos):
            found.append(t)
            pos = t[1]
        assert found == regex_tags(html), html


DAMAGED = ["<a ", '<a x="', "<title>", '<a x=">', "<b>", "<b><hr>", "<i></b>", "<p><td><b><hr>", "<!--", "<a href='", "<li><b>", "</p>", "<a <a '\" >", "<p>x"]


@pytest.mark.parametrize("part", DAMAGED)
def test_damaged_pages_take_linear_time(part):
    """100, 200 and 400 kB of one damaged tag, with and without a closing end."""

    def took(kb, tail):
        html = part * (kb * 1000 // len(part)) + tail
        start = time.process_time()
        dom.read_page(html)
        dom.parse(html)
        return time.process_time() - start

    for tail in ("", ">", "</b></i>'>", '">'):
        times = [took(kb, tail) for kb in (100, 200, 400)]
        assert times[2] < 3.0 and times[2] < 12 * max(times[0], 0.02), (tail, times)


def test_lines_of_many_words_spread_over_fewer_sites(spark):
    """Long passages count from 3 sites, short lines from 10; both are parameters."""
    long, longer, short = (" ".join(f"{p}{i}" for i in range(n)) for p, n in (("a", 20), ("b", 60), ("c", 19)))
    rows = [(s, f"own {s}\n{long if s < 3 else ''}\n{longer if s < 2 else ''}\n{short if s < 9 else ''}\nmenu" + (" x" if s == 10 else ""), f"site{s}") for s in range(11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.row.doc_id: r.text for r in line_dedup.clean_lines(df).collect()}
    assert got == B.without_lines([(d, s, t) for d, t, s in rows])
    assert sum(long in t for t in got.values()) == 1 and sum(longer in t for t in got.values()) == 2 and sum(short in t for t in got.values()) == 9 and sum("menu" in t for t in got.values()) == 2
    assert sum(longer in r.text for r in line_dedup.clean_lines(df).collect()) == 2
    lines = line_dedup.boilerplate(df, min_sites=9, min_sites_long=2).collect()
    assert sorted(r.n_sites for r in lines) == [2, 3, 9, 10]


def test_one_row_of_each_class_stays(spark):
    base = [f"w{i}" for i in range(60)]
    a, b, c = " ".join(base), " ".join([*base[:-1], "z"]), "an entirely different text of nine words in all"
    kind = "doc_id long, text string, source string"
    kept = lambda rows: sorted(near_duplicates.one_of_each(spark.createDataFrame(rows, kind)).collect(), key=str)
    assert len(kept([(1, a, "s"), (1, b, "s"), (2, a, "s")])) == 1
    assert len(kept([(None, a, "s"), (None, a, "s")])) == 1
    assert [r.doc_id for r in kept([(None, a, "s"), (5, b, "s"), (4, a, "s")])] == [4]
    ties = [(3, a, "s1"), (3, a, "s2"), (3, a, "s3")]
    assert len(kept(ties)) == 1 and kept(ties) == kept(ties[::-1])
    assert len(kept([(1, a, "s"), (1, c, "s"), (2, c, "s")])) == 2  # one key, two classes
    assert len(kept([(1, None, "s"), (1, "", "s"), (1, None, "s")])) == 3  # nothing to be like
    assert kept([]) == []


def test_formulas_figures_and_tables_of_an_article_stay():
    body = "<p>" + "Long text of the article about things. " * 12 + "</p>"
    html = f"<body><nav><a href=/x>Home</a></nav><article>{body}<p>If <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p><figure><img src=a><figcaption>A figure of it</figcaption></figure><table><tr><td>one</td><td>two</td></tr></table>{body}</article><form><label>Mail</label><button>Send</button></form></body>"
    lines = html_extraction.main_text(html).split("\n")
    assert "If x=2 holds." in lines and "A figure of it" in lines and "one" in lines and "two" in lines and not any("Send" in x or "Mail" in x or "Home" in x for x in lines)
