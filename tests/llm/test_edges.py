"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandemtext.llm import contamination, format_duplicates, labels, lookalikes, mixture, near_duplicates, pair_defects, shared_spans, survivorship, truncation

LONG = "".join(random.Random(5).choices("あいうえおかきくけこさしすせそ", k=60_000))
SENTENCE = "トカソボは緑の硬貨を失い、風鳴りの港に戻れない。ルヌギチマの話では、北の洞窟に剣が眠るらしい。キツブナンは王家の橋を離れた。"


@pytest.fixture
def memory(spark):
    rows = [
        (1, "Ａ b。", "X!", 0), (2, "ａB", "x", 0), (3, None, None, 0), (4, "", None, 0), (5, LONG, LONG, 0), (6, LONG + "。", LONG, 0), (7, "名称:剣／価格:1／重さ:2", "t", 0),
        (8, "重さ：2 | 名称：剣 | 価格：1", "T", 0), (9, "名称:剣／価格:1", "t", 0), (10, "名称剣価格1", "t", 0), (10, "名称剣価格1", "t", 0), (None, "名称剣価格1", "t", 0),
    ]
    df = spark.createDataFrame(rows, "entry_id bigint, source string, target string, sig int")
    return df.withColumns({c: F.lit("clash") for c in ("id", "s", "t", "k1", "rid", "text", "cid", "f0", "first_id")})


def test_format_duplicates(memory):
    got = sorted((r["first_id"], r["id"], r["copies"], r["variants"]) for r in format_duplicates.format_duplicates(memory, "entry_id", ["source", "target"]).collect())
    assert got == [(1, 1, 2, True), (1, 2, 2, True), (3, 3, 2, True), (3, 4, 2, True), (5, 5, 2, True), (5, 6, 2, True), (7, 7, 2, True), (7, 8, 2, True), (9, 9, 3, True), (9, 10, 3, True), (9, 10, 3, True)]
    assert format_duplicates.format_duplicates(memory.limit(0), "entry_id", ["source", "target"]).count() == 0
    assert {r["id"]: r["copies"] for r in format_duplicates.collapsed(memory, "entry_id", ["source", "target"]).collect()} == {1: 2, 3: 2, 5: 2, 7: 2, 9: 3}


def test_every_fold_meets_its_equals(spark):
    """Letters whose lower case depends on their place, widths, stat lines, null and empty, in both fields."""
    rows = [(1, "ΛΟΓΟΣ", None), (2, "λογος。", ""), (3, "ΛΟΓΟΣ Α", "x"), (4, "λογοσα", "X"), (5, "İz", "İ"), (6, "i̇Z", "i̇"), (7, "名:ΣΑΣ／価:1／重:2", "t"), (8, "重：2|価：1|名：σας", "t"), (9, None, None), (10, None, None)]
    df = spark.createDataFrame(rows, "id bigint, a string, b string")
    got = {(r["first_id"], r["id"]): r["variants"] for r in format_duplicates.format_duplicates(df, "id", ["a", "b"]).collect()}
    assert got == {(1, 1): True, (1, 2): True, (3, 3): True, (3, 4): True, (5, 5): True, (5, 6): True, (7, 7): True, (7, 8): True, (9, 9): False, (9, 10): False}


def test_skeletons():
    table = lookalikes.Prototypes()
    same = [("ＨＰ　１", "HP 1"), ("ガ", "ガ"), ("ｶﾞ", "ガ"), ("Ｏrdée", "Ordе́e"), ("力", "カ"), ("⾚土", "赤土"), ("海", "海"), ("a​b", "ab"), ("…", "..."), ("工", "エ")]
    for a, b in same:
        assert lookalikes.skeleton_text(a, table) == lookalikes.skeleton_text(b, table), (a, b)
    for a, b in [("カ", "ガ"), ("１", "２"), ("ッ", "ツ"), ("a", "A"), ("a\nb", "a b"), ("①", "1"), ("ハ", "パ"), ("²", "2")]:
        assert lookalikes.skeleton_text(a, table) != lookalikes.skeleton_text(b, table), (a, b)


def test_lookalike_pairs(spark):
    left = spark.createDataFrame([(1, "カ", 1), (2, "力", 1), (3, None, 1), (4, "", 1), (5, LONG + "カ", 1), (5, LONG + "カ", 1), (None, "カ", 1)], "id bigint, t string, s1 int")
    right = spark.createDataFrame([(1, "カ", 1), (2, "ガ", 1), (3, None, 1), (4, "​", 1), (5, LONG + "力", 1)], "id bigint, t string, r1 int")
    got = sorted(map(tuple, lookalikes.lookalike_pairs(left, "id", "t", right, "id", "t").collect()))
    assert got == [(2, 1), (4, 4), (5, 5), (5, 5), (5, 5), (5, 5)] or got == [(2, 1), (4, 4), (5, 5), (5, 5)]
    assert lookalikes.lookalike_pairs(left.limit(0), "id", "t", right, "id", "t").count() == 0
    forms = {r["id"]: r["form"] for r in lookalikes.consistent_form(left.where("id < 5"), "id", "t").collect()}
    assert forms[1] == forms[2] and forms[3] is None and forms[4] == ""


def test_survivors(spark):
    rows = [
        (1, "s", "c", "low", "a", "2025-01-02"), (2, " s", "c　", "top", "X/B", "2025-01-03"), (3, "s", "c", "", "b", "2025-02-01"), (4, "s", None, "no", "b", "2025-01-01"), (5, "t", "c", "x", "b", "2025-01-01"),
        (6, "t", "c", "y", "b", "2025-01-01"), (7, "u", "c", None, None, None), (8, "u", "c", "only", None, None), (9, "v", "c", None, "a", None), (10, "v", "c", " ", "a", None), (None, "s", "c", "z", "b", "2026-01-01"),
    ]
    df = spark.createDataFrame(rows, "id bigint, source string, context string, target string, file string, at string").withColumns({"committed_at": F.to_timestamp("at"), "g1": F.lit(1), "vote_trust": F.lit(9), "trust": F.lit(9)})
    files = spark.createDataFrame([("a", 1), ("b", 5), ("c", None)], "file string, trust int")
    got = {r["first_id"]: (r["members"], r["target_id"], r["target_dominant"]) for r in survivorship.survivors(df, files, "id", ["source", "context"], ["target"]).collect()}
    assert got == {1: (3, 2, 2), 5: (2, 5, None), 7: (2, 8, 8), 9: (2, None, None)}
    assert survivorship.survivors(df.limit(0), files, "id", ["source", "context"], ["target"]).count() == 0
    assert survivorship.survivors(df, files.limit(0), "id", ["source", "context"], ["target"]).count() == 4


def test_the_dominant_row_is_elected_by_votes(spark):
    """best_id is the row with the most votes of its own, trust times decay; it is dominant only if none is more trusted or later."""
    day = 86_400_000_000
    rows = [
        (1, 1, "f", 1, 1, 5, 20_000 * day, 1, 1), (1, 1, "f", 2, 2, 1, 19_000 * day, 9, 2), (2, 2, "f", 1, 1, 9, 20_000 * day, 1, 11), (2, 2, "f", 2, 2, 0, 20_100 * day, 1, 12), (3, 3, "f", 1, 1, 2, 20_000 * day, 1, 21),
        (3, 3, "f", 2, 2, 1, 20_365 * day, 1, 22), (4, 4, "f", 1, 1, -3, 20_000 * day, 1, 31), (4, 4, "f", 2, 2, -3, 20_500 * day, 1, 32), (5, 5, "f", 1, 1, 3, 20_000 * day, 2, 41),
    ]
    df = spark.createDataFrame(rows, "g1 bigint, g2 bigint, field string, v1 bigint, v2 bigint, vote_trust int, at bigint, n bigint, first_id bigint")
    cast = df.withColumn("votes", F.col("n") * (1 + F.col("vote_trust")) * F.pow(F.lit(2.0), F.col("at") / F.lit(365.0 * day) - F.lit(60.0)))
    got = {r["g1"]: (r["best_id"], r["dominant_id"]) for r in survivorship.elected(cast).collect()}
    assert got == {1: (1, 1), 2: (11, None), 3: (22, None), 4: (32, 32), 5: (41, None)}


def test_shared_spans(spark):
    a, b = LONG[:300], LONG[300:500]
    tag = "<tag id='1' type='br' desc='x'/>"
    rows = [(1, a), (2, a), (3, "x" + a[100:150] + "y"), (4, b[:39]), (5, b), (6, a[:30] + tag + a[30:60]), (7, None), (8, ""), (9, LONG), (10, "ab" * 40), (None, a)]
    df = spark.createDataFrame(rows, "rid bigint, text string").withColumns({"h": F.lit(1), "start": F.lit(2)})
    got = sorted(map(tuple, shared_spans.shared_spans([df.where("rid < 5"), df.where("rid >= 5 or rid is null")]).collect()))
    assert got == [(1, 1, 300), (2, 1, 300), (3, 2, 50), (5, 1, 200), (9, 1, 500)]
    assert shared_spans.shared_spans([df.limit(0)]).count() == 0


def test_index_is_compacted_and_reopened(spark, tmp_path):
    index = shared_spans.FingerprintIndex(spark, str(tmp_path / "index"), fanout=2)
    for i in range(5):
        index.append(spark.createDataFrame([(i, LONG[i * 60 : i * 60 + 100])], "rid bigint, text string"))
    assert sorted(level for level, _ in index.runs) == [0, 2]
    again = shared_spans.FingerprintIndex.open(spark, str(tmp_path / "index"), fanout=2)
    assert again.runs == index.runs and again.postings().count() == index.postings().count()
    assert sum(p.name.startswith("run_") for p in (tmp_path / "index").iterdir()) == 2
    with pytest.raises(ValueError):
        shared_spans.FingerprintIndex.open(spark, str(tmp_path / "index"), span=50)


def test_runs_are_merge_joined_without_shuffling(spark, tmp_path):
    index = shared_spans.FingerprintIndex(spark, str(tmp_path / "index"))
    for i in range(2):
        index.append(spark.createDataFrame([(2 * k + i, LONG[k * 90 : k * 90 + 100]) for k in range(50)], "rid bigint, text string"))
    a, b = (index._run(name, False) for _, name in index.runs)
    plan = a.join(b.select("h").hint("merge"), "h", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan


def test_batches_give_what_one_call_gives(spark, tmp_path):
    """One batch a call, the index opened anew each time, hot spans among them, against all records at once."""
    a, b, hot = LONG[:300], LONG[300:500], LONG[2000:2060]
    rows = [(1, a), (2, "x" + a[100:150] + "y"), (3, b), (4, b[:39]), (5, LONG[700:800]), (6, a), (7, b[50:120] + "z" + LONG[720:790]), (8, LONG[900:990]), (9, LONG[900:990]), (10, "q" + LONG[710:760]), (11, b[:45] + a[290:])]
    rows += [(100 + k, LONG[3000 + 50 * k : 3030 + 50 * k] + hot[: 60 - k % 3]) for k in range(90)] + [(300, hot[:50]), (301, "q" + hot[3:]), (302, a)]
    df = spark.createDataFrame(rows, "rid bigint, text string").coalesce(1)
    cuts = ["rid <= 4", "rid in (5, 6, 7, 300)", "rid between 100 and 149", "rid in (8, 9, 10, 11, 301)", "rid between 150 and 200 or rid = 302"]
    want = sorted(tuple(r) for r in shared_spans.shared_spans([df]).collect())
    path = str(tmp_path / "index")
    for k, cut in enumerate(cuts):
        index = shared_spans.FingerprintIndex.open(spark, path, fanout=2) if k else shared_spans.FingerprintIndex(spark, path, fanout=2)
        got = {tuple(r) for r in shared_spans.shared_spans([df.where(cut)], index=index).collect()}
        own = {r["rid"] for r in df.where(cut).collect()}
        now = {tuple(r) for r in index.spans().collect()}
        assert {r for r in now if r[0] in own} <= got <= now
    assert sorted(now) == want and len(want) > 95
    assert sorted(map(tuple, shared_spans.shared_spans([df.where(c) for c in cuts], index=shared_spans.FingerprintIndex(spark, fanout=2)).collect())) == want
    assert index.runs[0][0] == 2 and index._run(index.runs[0][1], True).count() > 50 and index._run(index.runs[0][1], False).count() > 50


def test_near_duplicates(spark):
    edited = SENTENCE.replace("緑", "赤")
    rows = [(1, SENTENCE, "t" * 50), (2, SENTENCE + "。", "t" * 50), (3, edited, None), (4, "短い", "t"), (5, None, None), (6, LONG, ""), (7, LONG[:-20], ""), (8, "あ" * 60, ""), (9, "あ" * 70, None), (None, SENTENCE, "t")]
    df = spark.createDataFrame(rows, "entry_id bigint, s string, t string").withColumns({"cid": F.lit(1), "a": F.lit(2), "id": F.lit(3), "bucket": F.lit(4)})
    got = sorted(map(tuple, near_duplicates.near_duplicate_pairs(df, "entry_id", "s", "t").collect()))
    assert got == [(1, 3), (2, 3), (6, 7), (8, 9)]
    assert near_duplicates.near_duplicate_pairs(df.limit(0), "entry_id", "s", "t").count() == 0


def test_short_folded_records_are_left_out_of_links(spark):
    """Records long enough only by tag markers, punctuation and blanks are no partners."""
    text = SENTENCE.replace("。", "").replace("、", "")[:46]
    rows = [(1, text, "t" * 50), (2, text[:44] + "。" * 20, "t" * 50), (3, text[:44] + "<tag id='1' type='br' desc='x'/>", "t" * 50), (4, text + "緑", "t" * 50)]
    df = spark.createDataFrame(rows, "entry_id bigint, s string, t string")
    got = sorted((r["id"], r["cid"], r["links"]) for r in near_duplicates.near_duplicate_links(df, "entry_id", "s", "t").collect())
    assert got == [(1, 1, 1), (4, 4, 1)]


def _packed(texts, part, monkeypatch):
    """The number of entries of each bucket, and the entries a class, for records with one phrase in common."""
    monkeypatch.setattr(near_duplicates, "HOT", 500)
    monkeypatch.setattr(near_duplicates, "BUCKET", 20_000)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts), pa.array([""] * len(texts))], ["cid", "s", "t"])
    total, counts, every = np.zeros(part.slots, np.int64), np.zeros(near_duplicates.BANDS, np.int64), []
    for cid, h, owner, size in near_duplicates._blocks(iter([batch])):
        his = part.bands(int(size.max()))
        band = np.searchsorted(his, size)
        keys, _, of = near_duplicates.group_keys(h, owner, np.ones(len(cid), bool), band, part, his)
        total += np.bincount((keys.ravel() & np.uint64(part.slots - 1)).astype(np.int64), minlength=part.slots)
        counts += np.bincount(band[of], minlength=near_duplicates.BANDS) * keys.shape[1]
        every.append(keys.ravel())
    key, n = np.frombuffer(near_duplicates.often(np.concatenate(every)), np.uint64).reshape(2, -1)
    hot = n >= 500
    return near_duplicates._entries(part, total, counts, (key[hot], -(-n[hot].astype(np.int64) // 500)))([batch]), int(hot.sum())


def test_entries_a_class_do_not_grow_with_a_hot_key(monkeypatch):
    rng, part = random.Random(6), near_duplicates.Partition(slots=1 << 10)
    sizes = {}
    for n in (400, 4_000):
        texts = ["".join(rng.choices("あいうえおかきくけこさしすせそたちつてと", k=60)) if k % 3 else "同" * 70 + chr(0x4E00 + k % 5000) for k in range(n)]
        batches, hot = _packed(texts, part, monkeypatch)
        import zstandard

        unpack, per = zstandard.ZstdDecompressor().decompress, {}
        for b in batches:
            for bucket, keys in zip(b.column("bucket").to_pylist(), b.column("keys").to_pylist(), strict=True):
                per[bucket] = per.get(bucket, 0) + len(unpack(keys)) // 4
        sizes[n] = (sum(per.values()) / n, max(per.values()), hot)
    assert sizes[4_000][2] > 0 and sizes[4_000][0] < 1.3 * sizes[400][0] and sizes[4_000][1] < 80_000


def test_very_large_sets_have_a_signature():
    part = near_duplicates.Partition()
    assert part.words(int(np.searchsorted(part.bands(1 << 40), 3_000_000))) > 10_000


def test_partition_loses_no_pair():
    """Any two sets at the threshold share a key that the larger one looks for."""
    rng, part = np.random.default_rng(2), near_duplicates.Partition(slots=1 << 10)
    for _ in range(150):
        n = int(rng.integers(1, 200))
        base = rng.integers(0, 1 << 50, n, dtype=np.uint64)
        gone = int(rng.integers(0, max(1, int(0.3 * n)) + 1))
        new = rng.integers(0, 1 << 50, int(rng.integers(0, max(1, int(0.25 * n)) + 1)), dtype=np.uint64)
        x, y = set(base.tolist()), set(base[gone:].tolist()) | set(new.tolist())
        if not y or len(x & y) * 10 < 7 * len(x | y):
            continue
        large, small = (x, y) if len(x) >= len(y) else (y, x)
        his = part.bands(len(large))
        frequency = rng.integers(0, 100, part.slots)
        keys = {}
        for name, s, band in (("large", large, int(np.searchsorted(his, len(small)))), ("small", small, int(np.searchsorted(his, len(small))))):
            h, owner = np.array(sorted(s), np.uint64), np.zeros(len(s), np.int64)
            k, m, of = near_duplicates.group_keys(h, owner, np.ones(1, bool), np.array([band]), part, his)
            need = part.differences(np.array([len(large)]), np.minimum(len(large), his[[band]])) + 1
            keys[name] = k[near_duplicates.allocated(k, m, of, need, frequency)] if name == "large" else k.ravel()
        assert set(keys["large"].tolist()) & set(keys["small"].tolist())


def test_leaks(spark):
    item = LONG[1000:1200]
    docs = [(1, LONG[:900] + item + LONG[:50]), (2, "前" * 80 + item[30:100] + "後"), (3, item[:69] + "違" + LONG[5000:5100]), (4, None), (5, ""), (6, LONG[20_000:]), (None, item), (7, item), (7, item)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"id": F.lit(1), "t": F.lit("x"), "run": F.lit(0)})
    items = spark.createDataFrame([(9, item, "答え"), (10, None, None), (11, "", ""), (12, item[:20], "x"), (None, item, "x")], "item_id bigint, text string, answer string").withColumn("i", F.lit(1))
    got = sorted((r["doc_id"], r["item_id"]) for r in contamination.leaks(df, items).where("run >= 70").collect())
    assert got == [(1, 9), (2, 9), (7, 9), (7, 9)]
    assert sorted((r["doc_id"], r["item_id"]) for r in contamination.leaks(df, items, most_items=2).where("run >= 70").collect()) == got
    for a, b in ((df.limit(0), items), (df, items.limit(0))):
        assert contamination.leaks(a, b).count() == 0


def test_paraphrases_are_found(spark):
    """Every fifth code point is another, or half of each dozen: no run of a passage's length is left."""
    item = SENTENCE.replace("。", "").replace("、", "") + LONG[3000:3080]
    single = "".join("違" if k % 5 == 4 else ch for k, ch in enumerate(item))
    pieces = "".join(item[k : k + 8] + "別の話を" for k in range(0, len(item), 12))
    docs = spark.createDataFrame([(1, LONG[:500] + single + LONG[500:900]), (2, pieces), (3, LONG[:900]), (4, "x" + item)], "doc_id bigint, text string")
    items = spark.createDataFrame([(9, item, "緑の硬貨")], "item_id bigint, text string, answer string")
    got = {r["doc_id"]: r for r in contamination.leaks(docs, items).collect()}
    assert set(got) == {1, 2, 4} and [got[k]["run"] for k in (1, 2)] == [0, 0] and got[4]["run"] == len(item)
    for k, text in ((1, single), (2, pieces)):
        assert got[k]["overlap"] >= contamination.subsequence(item, text) / len(item) - 0.05
    assert {r["doc_id"] for r in contamination.leaks(docs, items, overlaps=False).collect()} == {4}


def test_texts_of_one_letter_leak(spark):
    """Every passage of the corpus has the same single feature, whose weight is 0; short periods, too."""
    docs = spark.createDataFrame([(1, "あ" * 200), (2, "あ" * 69), (3, "あ" * 70)], "doc_id bigint, text string")
    items = spark.createDataFrame([(9, "あ" * 200, "")], "item_id bigint, text string, answer string")
    assert sorted(r["doc_id"] for r in contamination.leaks(docs, items, overlaps=False).collect()) == [1, 3]
    docs = spark.createDataFrame([(1, "甲乙" * 50), (2, LONG[:300]), (3, "丙" + "甲乙丁" * 40)], "doc_id bigint, text string")
    items = spark.createDataFrame([(9, "乙甲" * 60, ""), (8, "乙丁甲" * 60, "")], "item_id bigint, text string, answer string")
    assert sorted((r["doc_id"], r["item_id"]) for r in contamination.leaks(docs, items, overlaps=False).collect()) == [(1, 9), (3, 8)]


def test_the_longest_of_several_runs_is_given(spark):
    item = LONG[1000:1400]
    docs = spark.createDataFrame([(1, item[:80] + "違" * 30 + item[90:390]), (2, item[300:] + "違" * 30 + item[:250])], "doc_id bigint, text string")
    items = spark.createDataFrame([(9, item, "")], "item_id bigint, text string, answer string")
    assert {r["doc_id"]: r["run"] for r in contamination.leaks(docs, items).collect()} == {1: 300, 2: 250}


def test_subsequence():
    for a, b in itertools.product(["", "abcab", "xaybz", "bbb"], repeat=2):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        assert contamination.subsequence(a, b) == row[-1]


def test_pivotal_keeps_sums_and_chances():
    rng, total = np.random.default_rng(1), np.zeros(40)
    weights, chances = rng.integers(1, 100, 40).astype(float), rng.random(40)
    for _ in range(3000):
        p, left = mixture.pivotal(weights, chances, rng)
        assert abs((weights * p).sum() - (weights * chances).sum()) < 1e-6
        assert all(x in (0.0, 1.0) for i, x in enumerate(p) if i != left)
        total += p
    assert np.abs(total / 3000 - chances).max() < 0.05


def test_mixture_edges(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, None, "x"), (3, "", "y"), (4, "d", None), (5, "e f", "z"), (None, "e", "x")], "doc_id bigint, text string, source string").withColumns({"tokens": F.lit(5), "g": F.lit(1), "p": F.lit(1)})
    targets = spark.createDataFrame([("x", 0.5, 2), ("y", 0.3, None), ("w", 0.2, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: w != "")).cast("bigint")
    chosen, report = mixture.mixture(docs, targets, counter=words, total=20)
    assert [tuple(r) for r in chosen.collect()] == [(1, "x", 3, 2)]
    assert {r["source"]: (r["reached"], r["capped"]) for r in report.collect()} == {"x": (6, True), "y": (0, True), "w": (0, True)}
    assert mixture.mixture(docs.limit(0), targets, counter=words)[0].count() == 0


def test_tokenizers(spark):
    import tokenizers  # noqa: F401

    df = spark.createDataFrame([("Hello world",), (None,), ("",), (LONG,)], "t string")
    for name in ("piece_bpe_32k.model", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"):
        n = [r[0] for r in df.select(mixture.token_counter(vocabulary=name)("t")).collect()]
        assert n[0] == 2 and n[1:3] == [0, 0] and n[3] > 10_000


def test_pair_defects(spark):
    rows = [
        (1, SENTENCE, ""), (2, SENTENCE, None), (3, SENTENCE, "<tag id='1' type='br' desc='x'/>​"), (4, SENTENCE, "译文：" + SENTENCE), (5, SENTENCE, "抱歉，作为语言模型，我不能翻译这段内容。"), (6, SENTENCE, "The green coin was lost and nobody returned to the port."),
        (7, "HP", "HP"), (8, "魔法", "魔法"), (9, None, "译文"), (10, None, None), (11, LONG, LONG), (None, SENTENCE, ""),
    ]
    good = [(100 + i, f"ゲム{i}は昨夜、港へ剣を{i}本隠した。ホケは緑の門を離れた。", f"盖姆{i}昨晚把{i}把剑藏到了港口。霍凯离开了绿色大门。") for i in range(150)]
    df = spark.createDataFrame(rows + good, "unit_id bigint, s string, t string").withColumns({"id": F.lit(0), "votes": F.lit(""), "h": F.lit(1)})
    got = {(r["id"], r["defect"]) for r in pair_defects.pair_defects(df, "unit_id", "s", "t").collect()}
    assert {(1, "empty"), (2, "empty"), (3, "empty"), (10, "empty"), (4, "copy"), (11, "copy"), (5, "refusal"), (6, "wrong_language")} <= got
    assert not [g for g in got if g[0] in (7, 8, 9) or g[0] >= 100]
    assert pair_defects.pair_defects(df.limit(0), "unit_id", "s", "t").count() == 0


def test_a_pair_keeps_several_labels(spark):
    """An English text that breaks off is in a wrong language and truncated; rare ideographs count as letters of the source."""
    assert pair_defects.scripts("𠮷カがA1é한") == {"kana": 2, "han": 1, "latin": 2, "other": 1}
    good = [(100 + i, f"ゲム{i}は昨夜、港へ剣を{i}本隠した。ホケは緑の門を離れた。", f"盖姆{i}昨晚把{i}把剑藏到了港口。霍凯离开了绿色大门。") for i in range(150)]
    both = [(1000 + i, f"ラム{i}は昨夜、港へ剣を隠した。ホケは緑の門を離れた。ミナは歌う。", f"Ramu number {i} hid a sword at the port last night. Hoke left the green ga [...]") for i in range(12)]
    df = spark.createDataFrame(good + both, "unit_id bigint, s string, t string")
    got = {(r["id"], r["defect"]) for r in pair_defects.pair_defects(df, "unit_id", "s", "t").collect()}
    assert {(1000 + i, d) for i in range(12) for d in ("wrong_language", "truncated")} == got


def test_cutoffs_are_validated_on_all_pairs(spark, monkeypatch):
    seen, validated = [], labels.validated_cutoff
    monkeypatch.setattr(labels, "validated_cutoff", lambda *x: seen.append(int(x[4].sum())) or validated(*x))
    rows = [(i, f"ゲム{i}は昨夜、港へ剣を{i}本隠した。ホケは緑の門を離れた。", f"盖姆{i}昨晚把{i}把剑藏到了港口。霍凯离开了绿色大门。") for i in range(6_000)]
    pair_defects.pair_defects(spark.createDataFrame([*rows, (-1, "", "x"), (-2, "x", None)], "unit_id bigint, s string, t string"), "unit_id", "s", "t").count()
    assert sorted(seen) == [6_000] * 4  # no excuse stands under several sources


def test_validated_cutoff():
    model = labels.LabelModel(0.1, np.array([[0.05, 0.9, 0.05]] * 2), np.array([[0.9, 0.05, 0.05]] * 2), 0.5)
    patterns, counts = np.array([[1, 1], [1, 0], [0, 0]]), np.array([80.0, 40.0, 880.0])
    low = labels.validated_cutoff(model, patterns, counts, np.array([[1, 0]]), np.array([10.0]))
    high = labels.validated_cutoff(model, patterns, counts, np.array([[1, 1]]), np.array([10.0]))
    assert model.posterior(np.array([[1, 0]]))[0] < 0.3 and low == 0.5 and high == 0.5
    near = labels.LabelModel(0.4, model.given_yes, model.given_no, 0.5)
    assert labels.validated_cutoff(near, patterns, counts, np.array([[1, 0]]), np.array([10.0])) < 0.5


def test_label_model_beats_its_functions():
    rng = np.random.default_rng(4)
    truth = rng.random(20_000) < 0.05
    votes = np.stack([np.where(rng.random(20_000) < right, truth, ~truth).astype(int) for right in (0.95, 0.9, 0.85, 0.9)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = labels.fit(patterns, counts.astype(float))
    said = model.posterior(votes) >= model.cutoff
    assert (said == truth).mean() > max((votes[:, k] == truth).mean() for k in range(4))
    assert abs(model.share - 0.05) < 0.02


def test_all_field_limits_are_found(spark):
    """Short ones and more than 32."""
    limits = [64, 80, *range(200, 200 + 40 * 32, 32)]
    lengths = [n for n in range(30, 1500) for _ in range(2)] + [n for n in limits for _ in range(40)]
    df = spark.createDataFrame([("x" * n,) for n in lengths], "t string")
    assert truncation.field_limits(df, "t") == set(limits)


def test_closings_are_relative_to_the_corpus(spark):
    texts = [f"物語{i}は終わった。\n以上" for i in range(40)] + [f"別の話{i}だ。\n稀な{i}" for i in range(40)] + [None, ""]
    found = truncation.closings(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    assert "以上" in found.lines and "以上" in found.tails and not any(x.startswith("稀な1") for x in found.lines) and {"った", "話だ"} & found.words == {"った"}
    assert truncation.closings(spark.createDataFrame([], "t string"), "t") == truncation.Closings()
    assert truncation.closings(spark.createDataFrame([(t,) for t in texts], "t string"), "t", share=0.9).lines == frozenset()


def test_small_and_large_fits_agree(spark, data):
    """A fit on a tenth of the documents finds nearly what the fit on all of them finds in that tenth, and little else."""
    small, large = (spark.read.parquet(data.replace("0.001", sf) + "/documents.parquet") for sf in ("0.01", "0.1"))
    mine, other = truncation.fit(small, "doc_id", "text"), truncation.fit(large, "doc_id", "text")
    got, want = ({r["id"] for r in truncation.truncated(small, "doc_id", "text", "source", m).where("truncated").collect()} for m in (mine, other))
    assert len(got & want) >= 0.97 * len(want) and len(got & want) >= 0.88 * len(got)


def test_truncation(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    more = spark.read.parquet(data.replace("0.001", "0.01") + "/documents.parquet")
    model = truncation.fit(more, "doc_id", "text")
    assert model.held_out_recall > 0.95 and model.held_out_share < 0.12
    edge = spark.createDataFrame([(1, None, "a"), (2, "", None), (3, " \n", "a"), (4, LONG, "a"), (5, SENTENCE, "a"), (5, SENTENCE, "a"), (6, SENTENCE[:30], "a")], "doc_id bigint, text string, source string").withColumns({"id": F.lit(0), "t": F.lit(1), "score": F.lit(2)})
    got = {r["id"]: r["truncated"] for r in truncation.truncated(edge, "doc_id", "text", "source", model).collect()}
    assert got == {1: False, 2: False, 3: False, 4: True, 5: False, 6: True}
    rates = {r["source"]: (r["docs"], r["truncated_docs"]) for r in truncation.rates(truncation.truncated(edge, "doc_id", "text", "source", model)).collect()}
    assert rates == {"a": (6, 2), None: (1, 0)}
    assert truncation.truncated(df.limit(0), "doc_id", "text", "source").count() == 0


def test_p6_groups_are_selective():
    """Sets of phrases that many texts share meet in few keys: groups that lose one of two segments would leave two or three tokens, which are everywhere."""
    import random

    import numpy as np

    from tandemtext.llm import near_duplicates as nd

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("アイウエオカキクケコサシスセソ") for _ in range(4))
    words, phrases = [word() for _ in range(60)], [word() + "の" + word() + "は" + word() for _ in range(12)]
    texts = ["".join(rng.choice(phrases) + rng.choice(words) for _ in range(6)) for _ in range(1500)]
    h, owner = nd.token_sets(texts, [""] * len(texts))
    size = np.bincount(owner, minlength=len(texts))

    def meetings(part: nd.Partition) -> int:
        his = part.bands(int(size.max()))
        band = np.searchsorted(his, size)
        keys, m, of = nd.group_keys(h, owner, np.ones(len(texts), bool), band, part, his)
        frequency = np.bincount((keys.ravel() & np.uint64(part.slots - 1)).astype(np.int64), minlength=part.slots)
        probes = keys[nd.allocated(keys, m, of, part.differences(size, size) + 1, frequency)]
        every = np.sort(keys.ravel())
        return int((np.searchsorted(every, probes, "right") - np.searchsorted(every, probes)).sum()) - len(probes)

    assert 0 < meetings(nd.Partition()) < 0.8 * meetings(nd.Partition(pieces=2))
