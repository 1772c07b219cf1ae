"""Operators 11 to 13 against plain versions."""

import hashlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from fabula.llm import alignment, filter_audit, mixture

from .data import corpus

SCHEMA = "doc_id bigint, text string, source string, lang string, size bigint, id string, part string, container bigint, mask int"
SPACES = b" \t\n\x0b\x0c\r"


def rows_of(pairs, sources=("b", "a", None, "c")):
    return [(i, t, sources[k % len(sources)], ("en", None, "", "fr")[k % 4], 9, "x", "y", 1, 2) for k, (i, t) in enumerate(pairs)]


@pytest.fixture(scope="module")
def given(spark):
    """Awkward texts, null and repeated ids, equal rows, and columns named like internal ones."""
    text = "Some Words that are here more than once # and that are here again " * 5
    odd = [(None, text), (None, text), (3, text), (3, text), (3, "another"), (900, None), (901, "é " * 210 + "A" * 30), (902, "a b " * 300_000)]
    return rows_of([*corpus(), *odd])


@pytest.fixture(scope="module")
def docs(spark, given):
    return spark.createDataFrame(given, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return tuple((x is None, x) for x in row)


def ask(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toPandas() if not hasattr(df, "num_rows") else df)
    return con.sql(sql)


# ---- 11
def n_words(text):
    return len((text or "").encode().split())


def test_targets_fill_up_by_weight(docs, given):
    sizes = Counter()
    for _, text, source, *_ in given:
        sizes[source] += n_words(text)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    want, left, active = {}, 1.5 * sum(sizes.values()), set(order)
    while True:
        level = left / sum(weight[s] for s in active)
        over = {s for s in active if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            want[s] = 2 * sizes[s]
            left -= want[s]
        active -= over
    want |= {s: level * weight[s] for s in active}
    got = {r["source"]: r for r in mixture.report(mixture.plan(docs)).collect()}
    assert got.keys() == want.keys()
    for s, r in got.items():
        assert r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s])
        assert abs(r["taken"] - r["target"]) <= mixture.BLOCK


@pytest.mark.parametrize("shard_words", [mixture.SHARD_WORDS, 700])
def test_plan_takes_what_is_left_to_it_and_repeats(docs, given, shard_words):
    planned = mixture.plan(docs, shard_words=shard_words).cache()
    rows = planned.collect()
    assert sorted(key((r["id"], r["size"])) for r in rows) == sorted(key((i, n_words(t))) for i, t, *_ in given)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    again = mixture.plan(docs.repartition(3), shard_words=shard_words).collect()
    shown = lambda found: sorted(key((r["id"], r["size"], r["taken"], r["rounds"])) for r in found)
    assert shown(rows) == shown(again)
    texts = mixture.mixed(docs, planned).collect()
    taken = Counter()
    for r in texts:
        taken[r["id"]] += n_words(r["text"])
    want = Counter()
    for r in rows:
        want[r["id"]] += r["taken"]
    assert +taken == +want
    by_source = defaultdict(lambda: [0, 0])
    for r in rows:
        by_source[r["source"]][0] += r["taken"]
        by_source[r["source"]][1] = r["target"]
    n_shards = len({(r["source"], r["shard"]) for r in rows})
    assert all(abs(a - b) <= mixture.BLOCK * max(1, n_shards) for a, b in by_source.values())


@pytest.mark.parametrize("settings", [{}, {"shard_words": 900, "block": 16, "weights": (1, 5), "share": 0.5, "limit": 1, "seed": "s"}])
def test_plan_equals_every_quotient_written_out(spark, settings):
    rows = [(i, t, s, *rest) for (i, t, s, *rest) in rows_of(corpus(3), ("b", "a", "d", "c", None))]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixture.plan(df, **settings).select("id", "source", "size", "source_size", "target", "taken", "rounds", "shard").collect()
    table = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "source": [r[2] for r in rows]})
    want = ask(mixture.sql(**settings), documents=table).select("doc_id, source, size, source_size, target, taken, rounds, shard").fetchall()
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, want))


def test_apportionment_gives_each_seat_to_the_highest_quotient(spark):
    rng = np.random.default_rng(3)
    rows = [(g, k, float(w), seats) for g, seats in ((0, 0), (1, 1), (2, 37), (3, 5000)) for k, w in enumerate(rng.choice([0, 1, 1, 3, 7, 900, 12345], 23))]
    got = {(r["g"], r["k"]): r["n"] for r in mixture.apportion(spark.createDataFrame(rows, "g int, k int, w double, seats int"), "g", "k", "w", "seats", "n").collect()}
    for g in range(4):
        mine = [r for r in rows if r[0] == g]
        won = Counter()
        for _ in range(mine[0][3]):
            won[max((r for r in mine if r[2] > 0), key=lambda r: (r[2] / (2 * won[r[1]] + 1), -r[1]))[1]] += 1
        assert {k: n for (h, k), n in got.items() if h == g} == {r[1]: won[r[1]] for r in mine}


def test_mixture_without_words(spark, empty):
    assert mixture.plan(empty).count() == 0
    rows = mixture.plan(spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id bigint, text string, source string")).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in rows] == [(0, 0.0, 0)] * 2


# ---- 12
def aligned(rows):
    """Whole texts through the libraries, every pair of tokens compared within its group."""
    a, a_bytes, b, b_bytes = alignment.load(*alignment.default_paths())
    found, counts = [], Counter()
    for i, text, *_ in rows:
        raw = (" " + (text or "")).encode()
        first = a.encode(" " + text, add_special_tokens=False).ids if text else []
        second = b.encode(text) if text else []
        if b"".join(a_bytes[x] for x in first) != raw or b"".join(b_bytes[x] for x in second) != raw:
            found.append((i, [], [], [], []))
            continue
        ends = [np.cumsum([len(table[x]) for x in ids]).tolist() for ids, table in ((first, a_bytes), (second, b_bytes))]
        common, groups, links, at = set(ends[0]) & set(ends[1]), [], [], [0, 0]
        for end in sorted(common):
            to = [ends[0].index(end, at[0]) + 1, ends[1].index(end, at[1]) + 1]
            x, y = range(at[0], to[0]), range(at[1], to[1])
            groups.append(",".join(str(first[p]) for p in x) + "|" + ",".join(str(second[q]) for q in y))
            start = lambda k, p: ends[k][p - 1] if p else 0  # noqa: B023, E731
            links += [(first[p], second[q]) for p in x for q in y if start(0, p) < ends[1][q] and start(1, q) < ends[0][p]]
            at = to
        counts.update(links)
        found.append((i, first, second, groups, links))
    best = Counter()
    for (_, q), n in counts.items():
        best[q] = max(best[q], n)
    for i, first, second, groups, links in found:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if first else ""
        yield i, len(first), len(second), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha


COLUMNS = ("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
HARD = ["  two  spaces \n and a space ▁ here", "<|endoftext|> <s> hi </s> <0x41>", "x" * 5000, "日本語のテキスト 🎉🎉 é", " ", "tab\tand\x1c \x85 x", "don't can't ' 's", "a b c"]


def test_alignment_equals_brute_force(spark, docs, given):
    want = sorted(map(key, aligned(given)))
    assert sorted(key(tuple(r)) for r in alignment.align(docs).select(*COLUMNS).collect()) == want
    hard = rows_of(enumerate(HARD * 2))
    got = alignment.align(spark.createDataFrame(hard, SCHEMA)).select(*COLUMNS).collect()
    assert sorted(key(tuple(r)) for r in got) == sorted(map(key, aligned(hard)))


def test_alignment_in_small_slices_and_containers(spark, monkeypatch):
    """Bitmaps of many containers, long texts in many slices: the same result. ``run`` sees module settings through local
    workers, so the pieces are tried directly."""
    words = "the quick brown fox and the 12345 jumps überall " * 40
    monkeypatch.setattr(alignment, "SLICE", 64)
    aligner, held = alignment.Aligner(*alignment.default_paths()), alignment.Container(0)
    row = alignment._long_document(aligner, held, 0, words)
    (_, *want) = next(aligned([(1, words)]))
    assert row == (*want[:4], want[6])
    keys, counts = alignment.merged(held.pieces)
    assert counts.sum() == row[3] and len(np.unique(keys)) == len(keys)
    assert alignment.readable(pa.array([b"\xff\xfe", None, b"x"])) == ["", "", "x"]


def test_bitmaps_hold_documents_and_multiplicities():
    held, rng, want = alignment.Container(5), np.random.default_rng(1), Counter()
    for place in range(3000):
        pairs = np.unique(np.r_[7, rng.integers(0, 400, 20)])
        counts = rng.integers(1, 70, len(pairs))
        held.add(pairs << alignment.PLACE_BITS | place, counts)
        want.update({(int(p), place): int(n) for p, n in zip(pairs, counts, strict=True)})
    held.add(np.array([7 << alignment.PLACE_BITS | 3]), np.array([64]))
    want[7, 3] += 64
    held.documents = 3000
    got = Counter()
    for pair, plane, dense, bits in zip(*(x.tolist() if hasattr(x, "tolist") else x for x in held.bitmaps()), strict=True):
        raw = bits if isinstance(bits, bytes) else bits.as_py()
        places = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8))) if dense else np.frombuffer(raw, "<u2")
        for place in places.tolist():
            got[pair, place] += 1 if plane == 0 else 1 << plane - 1
    assert got == want


def test_pairs_count_documents_and_links(spark):
    df = spark.createDataFrame([(1, "the cat the cat"), (2, "the dog"), (3, None)], "doc_id bigint, text string")
    found = alignment.pair_counts(alignment.postings(df)).collect()
    counts = Counter((r["n_docs"], r["n_links"]) for r in found)
    assert counts == Counter({(2, 3): 1, (1, 2): 1, (1, 1): 1})
    assert all(r["best"] for r in found)
    texts = {r["id"]: r["groups"] for r in alignment.groups(df).collect()}
    assert texts[3] == "" and texts[1].count(";") == 3


def test_alignment_of_nothing(empty):
    assert alignment.align(empty).count() == 0


# ---- 13
def removed_by_hand(rows, labels):
    """Every order applied document by document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least, fails = {}, []
    for i, text, *_ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, text, _, lang, *_ in rows:
        raw = (text or "").encode().split()
        text = text or ""
        f = {"A": len(raw) < 200, "B": 100 * len(set(raw)) < 50 * len(raw), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text)}
        f |= {"D": any(c in "#$%&*|" for c in text), "E": i is not None and least[text] < i}
        fails.append((lang or "", {k for k, v in f.items() if v}, i in good, i in toxic))
    out, shapley = [], Counter()
    for part in {p for p, *_ in fails}:
        mine = [x[1:] for x in fails if x[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                redundant = sum(f in x[0] for x in mine) - len(gone)
                out.append((part, "".join(order), step, len(left), len(gone), redundant, sum(x[0] == {f} for x in mine), sum(x[1] for x in gone), sum(x[2] for x in gone)))
                shapley[part, f] += len(gone)
    return [(*x, shapley[x[0], x[1][x[2] - 1]]) for x in out]


def test_audit_equals_every_order_applied(spark, docs, given):
    labels = [(k, k % 2, k % 3 == 0) for k in range(0, 40)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (5, None, None), (99999, 1, 1)]
    labels = [(i, q, t if t is None else int(t)) for i, q, t in labels]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = filter_audit.audit(filter_audit.mask_counts(docs, table))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == sorted(removed_by_hand(given, labels))


def test_intervals_cover_each_order_once():
    for mask in range(32):
        seen = Counter(rank for _, first, last in filter_audit.intervals(mask) for rank in range(first, last + 1))
        assert seen == (Counter(range(120)) if mask else Counter())
        for step, first, last in filter_audit.intervals(mask):
            for rank in (first, last):
                order = filter_audit.ORDERS[rank]
                assert mask >> "ABCDE".index(order[step - 1]) & 1
                assert not any(mask >> "ABCDE".index(f) & 1 for f in order[: step - 1])


def test_audit_of_nothing(spark, empty):
    assert filter_audit.audit(filter_audit.mask_counts(empty, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))).count() == 0
