"""The found queries against plain brute force on the smallest tables."""

import collections
import re

import pyarrow.parquet as pq
import pytest
import regex

from tandemtext.llm import queries as q

FOLD = regex.compile(r"<tag\b[^<>]*/>|[\p{White_Space}\p{P}]")
TAG = re.compile(r"<tag\b[^<>]*/>")


def fold(s):
    return FOLD.sub("", s or "").lower()


@pytest.fixture(scope="module")
def tables(data):
    return lambda name, *cols: list(zip(*(pq.read_table(f"{data}/{name}.parquet", columns=[c])[c].to_pylist() for c in cols), strict=True))


def found(f, spark, data):
    rows = [tuple(r) for r in f(spark, data).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_p1(spark, data, tables):
    windows = collections.defaultdict(list)
    for tab, ident, text in [("tm_store", *r) for r in tables("tm_store", "entry_id", "source")] + [("transunit", *r) for r in tables("transunit", "unit_id", "source_text")]:
        at, text = 0, text or ""
        for m in [*TAG.finditer(text), None]:
            for j in range(at, (m.start() if m else len(text)) - 39):
                windows[text[j : j + 40]].append((tab, ident, j))
            at = m.end() if m else at
    shared = collections.defaultdict(set)
    for places in windows.values():
        if len({p[:2] for p in places}) > 1:
            for tab, ident, j in places:
                shared[tab, ident].update(range(j, j + 40))
    want = set()
    for (tab, ident), chars in shared.items():
        for j in sorted(chars):
            if j - 1 not in chars:
                n = 1
                while j + n in chars:
                    n += 1
                want.add((tab, ident, j + 1, n))
    assert want and found(q.p1_found, spark, data) == want


def test_p3(spark, data, tables):
    def form(x):
        x = TAG.sub("", x or "")
        parts = [p for p in re.split("[／｜|;、\n\r]", x) if p.strip()]
        if len(parts) >= 3 and all(re.match(r"[^:：]+[:：].*\S", p, re.S) for p in parts):
            return tuple(sorted({fold(p) for p in parts} - {""}))
        return fold(x)

    groups = collections.defaultdict(list)
    for e, s, t in tables("tm_store", "entry_id", "source", "target"):
        groups[form(s), form(t)].append((e, s, t))
    first = lambda m: min(x[0] for x in m)
    want = {(first(m), e) for m in groups.values() if len({x[1:] for x in m}) > 1 for e, *_ in m if e != first(m)}
    assert want and found(q.p3_found, spark, data) == want
    left = {r["id"]: r["copies"] for r in q.p3_collapsed(spark, data).collect()}
    assert left == {first(m): len(m) for m in groups.values()}


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_same_as_sql(spark, data, name):
    import os

    import duckdb

    db = duckdb.connect()
    for f in os.listdir(data):
        db.execute(f"create view {f[:-8]} as select * from '{data}/{f}'")
    df = q.QUERIES[name](spark, data)
    cursor = db.execute(q.ORACLE_SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(map(tuple, df.select(*names).collect()), key=key) == sorted(cursor.fetchall(), key=key)


def test_p4_pairs_look_alike(spark, data, tables):
    from tandemtext.llm.lookalikes import Prototypes, skeleton_text

    table = Prototypes()
    units = [(u, s) for u, s in tables("transunit", "unit_id", "source_text") if s is not None]
    entries = collections.defaultdict(list)
    for e, s in tables("tm_store", "entry_id", "source"):
        entries[skeleton_text(s or "", table)].append((e, s))
    want = {(u, e) for u, s in units for e, t in entries[skeleton_text(s, table)] if t != s and t is not None}
    assert found(q.p4_found, spark, data) == want


def test_p6(spark, data, tables):
    classes = collections.defaultdict(list)
    for e, s, t in tables("tm_store", "entry_id", "source", "target"):
        if len(fold(s)) >= 45:
            classes[fold(s), fold(t)].append(e)
    sets = [({x[i : i + 3] for x in k for i in range(len(x) - 2)}, ids) for k, ids in classes.items()]
    want = set()
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if 10 * len(a & b) >= 7 * len(a | b):
                want |= {(min(u, v), max(u, v)) for u in x for v in y}
    assert want and found(q.p6_found, spark, data) == want
    links = {r["id"]: r["links"] for r in q.p6_links(spark, data).collect()}
    assert set(links) == {e for ids in classes.values() for e in ids} and sum(links.values()) > 0


def test_p7(spark, data, tables):
    runs = collections.defaultdict(set)
    for i, t in tables("eval_items", "item_id", "text"):
        f = fold(t)
        for j in range(len(f) - 69):
            runs[f[j : j + 70]].add(i)
    want = set()
    for d, t in tables("documents", "doc_id", "text"):
        f = fold(t)
        for j in range(len(f) - 69):
            want |= {(d, i) for i in runs.get(f[j : j + 70], ())}
    assert found(q.p7_found, spark, data) == want


def test_p8(spark, data, tables):
    from tandemtext.llm import mixture
    from tandemtext.session import table

    chosen, report = mixture.mixture(table(spark, data, "documents"), table(spark, data, "mix_targets"), group=20, fan_in=3)
    rows, shares = chosen.collect(), report.collect()
    wanted = {r["source"]: r for r in shares}
    used, largest = collections.Counter(), collections.Counter()
    for r in rows:
        used[r["source"]] += r["tokens"] * r["copies"]
        largest[r["source"]] = max(largest[r["source"]], r["tokens"])
        assert 1 <= r["copies"] <= wanted[r["source"]]["max_repeats"]
    for s, r in wanted.items():
        assert r["reached"] == used[s]
        assert abs(used[s] - min(r["budget"], r["have"] * r["max_repeats"])) <= largest[s] + 1
        assert r["capped"] == (r["have"] * r["max_repeats"] < r["budget"])
    again = mixture.mixture(table(spark, data, "documents").repartition(7), table(spark, data, "mix_targets"), group=20, fan_in=3)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_p2_and_p9_find_the_plain_cases(spark, data, tables):
    defects = dict(found(q.p2_found, spark, data))
    plain = {u: (TAG.sub("", s or ""), TAG.sub("", t or "")) for u, s, t, st in tables("transunit", "unit_id", "source_text", "target_text", "status") if st != "NotStarted"}
    assert {u for u, (_, t) in plain.items() if not t.strip("​ \t\n　\xa0")} == {u for u, d in defects.items() if d == "empty"}
    for u, (s, t) in plain.items():
        if s and s == t and re.search("[ぁ-ヺ]", s):
            assert defects[u] == "copy"
    cut = {r[0] for r in found(q.p9_found, spark, data)}
    texts = dict(tables("documents", "doc_id", "text"))
    assert {d for d, t in texts.items() if t.endswith("�")} <= cut
    whole = {d for d, t in texts.items() if t.rstrip().endswith(("つづく", "以上", "★★★", "（了）"))}
    assert len(whole & cut) <= 1
