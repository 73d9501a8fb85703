"""Each corpus operator against brute force on a small table with nulls, ties, repeats, a long text and clashing columns."""

import re
from fractions import Fraction
from hashlib import sha1, sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard_join, language, mixing, motion_jpeg, quality, token_files, toxicity, url_filter, warc
from tidemark.llm.queries import tokenizer_path

PATH = "/root/testdata/sf0.001"
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty a b c d e f g h i j k l m n o p q r s t"
TEXTS = [
    None, "", "   \n", "Word", "word", "été 你好 \U0001f600", BASE, BASE + " extra", BASE + " extra", "zero " + BASE.replace("twenty", "TWENTY"), "only some other words here and there",
    " ".join(f"w{i % 5000}" for i in range(60_000)), "12 34 -- !!", "a\0b  c\t<|endoftext|> don't\nNow, end.",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "big" if i % 3 else None, i, "x", 1.0) for i, t in enumerate(TEXTS)]
    rows += [(None, "a text without an id", None, "small", 0, "x", 1.0), rows[6]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, node string, score double")


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{PATH}/documents.parquet")


def components_by_force(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    least = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and least[b] < least[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    least[a], changed = least[b], True
    return {i: (len(sets[i]), least[i]) for i in sets}


def test_jaccard_components(spark, docs, real):
    got = jaccard_join.jaccard_components(docs.where("doc_id is not null")).collect()
    want = components_by_force(list(enumerate(TEXTS)))
    assert len(got) == len(TEXTS) + 1 and all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got)
    rows = real.select("doc_id", "text").collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(real).collect()} == components_by_force([tuple(r) for r in rows])
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0
    assert jaccard_join.one_of_each(docs).where("doc_id in (6, 7, 8, 9)").count() == 1


def shared_lines(n, lines, each, seed=6):
    """Texts of a few lines that others have too; and near copies of some."""
    random = np.random.default_rng(seed)
    known = [" ".join(f"w{w}" for w in random.integers(0, 100_000, 9)) for _ in range(lines)]
    texts = [" ".join(known[i] for i in random.choice(lines, each, replace=False)) for _ in range(n)]
    return texts + [t + f" more{i}" for i, t in enumerate(texts[: n // 10])]


@pytest.mark.parametrize("most", [1 << 17, 900])
def test_jaccard_join_cuts_large_blocks(spark, monkeypatch, most):
    """Texts that are joined by shared lines, but not similar, and a group of near copies above the most tokens of a group."""
    monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", most)
    base = " ".join(f"n{i}" for i in range(60))
    texts = shared_lines(400, 300, 6) + [base + f" v{i} " + base[: i * 4] for i in range(40)]
    sizes, cut = [], jaccard_join._tries
    monkeypatch.setattr(jaccard_join, "_tries", lambda members, percent: (sizes.append(members), cut(members, percent))[1])
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(rows).collect()}
    assert got == components_by_force(list(enumerate(texts)))
    each = sizes[0].groupBy("block", "i", "j").agg(F.sum(F.size("tokens")).alias("m"), F.max("j").alias("parts")).collect()
    assert max(r.m for r in each) < 4 * most and (most > 900 or len(each) > 20)


def test_jaccard_join_deals_few_tokens_of_lone_texts(spark, monkeypatch):
    """Texts that link with nothing end after the first turns, and a text that others repeat is read once."""
    monkeypatch.setattr(jaccard_join, "HOT_SHARE", 1)  # no token is hot
    texts = shared_lines(300, 40_000, 20) + ["few words", "few words here", "one", ""] + [f"{'same ' * 3} words " * 2 + " ".join(f"c{i}" for i in range(100))] * 200
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    sent, shared = [], jaccard_join._shared
    monkeypatch.setattr(jaccard_join, "_shared", lambda dealt, bits, hot: (sent.append(dealt.agg(F.sum(F.length("nodes")) / 8).first()[0]), shared(dealt, bits, hot))[1])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(rows).collect()}
    want = components_by_force(list(enumerate(texts)))
    assert got == want
    assert sum(sent) < 0.7 * sum(n for n, _ in {t: want[i] for i, t in enumerate(texts)}.values())


def test_jaccard_join_deals_few_tokens_where_all_texts_have_near_copies(spark, monkeypatch):
    """Only the first turns are dealt, and sets go straight to their groups: each of them once, as no group is large."""
    monkeypatch.setattr(jaccard_join, "HOT_SHARE", 1)  # no token is hot
    base = shared_lines(60, 40_000, 20)[:60]
    texts = [t[: 15 * i] + f" one{i} " + t[15 * i :] for t in base for i in range(5)] + ["few words", "few words here", "a b c d e f g", "a b c d e f g h", "one", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    sent, members, shared, tries = [], [], jaccard_join._shared, jaccard_join._tries
    monkeypatch.setattr(jaccard_join, "_shared", lambda dealt, bits, hot: (sent.append(dealt.agg(F.sum(F.length("nodes")) / 8).first()[0]), shared(dealt, bits, hot))[1])
    monkeypatch.setattr(jaccard_join, "_tries", lambda sets, percent: (members.append(sets.count()), tries(sets, percent))[1])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(rows).collect()}
    want = components_by_force(list(enumerate(texts)))
    assert got == want and len({c for _, c in want.values()}) < 80
    assert sum(sent) < 0.4 * sum(n for n, _ in want.values()) and sum(members) <= len(texts)


def test_sizes_of_sets_that_link_are_at_most_a_class_apart():
    n = np.arange(1, 20_000)
    for percent in (1, 20, 50, 80, 99, 100):
        most = np.minimum(100 * n // percent, 1 << 40)
        assert (jaccard_join.size_class(most, percent) - jaccard_join.size_class(n, percent)).max() <= 1


def test_a_filter_of_rows_lets_all_of_them_through(spark):
    rows = np.random.default_rng(2).integers(-(1 << 63), 1 << 63, 200_000)
    found = jaccard_join.row_filter(spark.createDataFrame(pa.table({"row": rows[:100_000]})), 100_000)
    assert jaccard_join.passes(found, rows[:100_000]).all() and jaccard_join.passes(found, rows[100_000:]).mean() < 0.1


def test_hot_tokens_are_counted_by_cell(spark):
    texts = ["a line that all of them have here " + " ".join(f"u{i}x{j}" for j in range(4)) for i in range(300)] + ["a line that all of them have here"] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    cells, counts = jaccard_join.hot_cells(jaccard_join.sets_of(docs, 5), len(texts))
    total = np.zeros(1 << 20, int)
    for t in texts:
        w = t.split()
        from tidemark.llm import words
        from tidemark.llm.common import raw_bytes

        np.add.at(total, jaccard_join._cell(words.shingle_sets(*raw_bytes(pa.array([t])), 5)[1]), 1)
        assert len(w) > 7
    assert cells.tolist() == np.flatnonzero(total > len(texts) / 1000).tolist() and counts.tolist() == total[cells].tolist()


def test_cells_count_each_token_of_odd_rows(spark, docs):
    """Null ids and texts, empty and repeated rows; cells take more than 2**8 and 2**16 of a token."""
    from zlib import decompress

    many = docs.unionByName(spark.range(70_000).select(F.col("id").alias("doc_id"), F.lit("word").alias("text")), allowMissingColumns=True)
    written = jaccard_join.sets_of(many.coalesce(2), 5).toPandas()
    total = np.zeros((16, 1 << 16), np.int64)
    for r in written[written.slice.notna()].itertuples():
        total[int(r.slice)] += np.frombuffer(decompress(r.cells), np.uint32)
    assert total.sum() == written.n.sum() and total.max() >= 70_002


@pytest.mark.parametrize("most", [1, 3, 10_000])
def test_tries_are_those_of_blocks_whatever_the_batches(spark, most):
    """Rows of a block that come in several batches, rows that repeat, blocks of one set, and a pair of parts; no row is turned into an object of pandas."""
    from zlib import compress

    base = list(range(1 << 40, (1 << 40) + 20))
    sets = {1: base, 2: base[:18], 3: base[2:], 4: [x + 100 for x in base], 5: base[:19]}
    groups = [(7, 0, 0, {n: 0 for n in (1, 2, 3, 4)}), (8, 0, 0, {5: 0}), (9, 0, 1, {1: 0, 3: 0, 4: 1, 5: 1})]
    rows = []
    for block, i, j, members in groups:
        for node, part in members.items():
            tokens = np.array(sets[node], np.int64)
            low, high = tokens.astype(np.uint32).view(np.int32).tolist(), compress((tokens >> 32).astype(np.uint16).tobytes(), 1)
            rows += [(block, i, j, part, node, len(tokens), low, high)] * (3 if node in (1, 5) else 1)
    members = spark.createDataFrame(rows, "block long, i int, j int, part int, node long, n long, tokens array<int>, high binary").coalesce(1).sortWithinPartitions("block", "i", "j", "node")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    try:
        found = jaccard_join._tries(members, 80)
        links = sorted(tuple(sorted(r)) for r in found.collect())
        assert found.columns == ["a", "b"] and "InPandas" not in found._jdf.queryExecution().toString()
        assert jaccard_join._tries(members.limit(0), 80).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # 1 joins 2 and 3 of the first block, and its part's sets aren't compared with each other in the last
    joined = {frozenset(x) for x in links}
    assert len(links) == 4 and {frozenset(x) for x in ((1, 5), (3, 5))} <= joined and not any(4 in x for x in joined)
    assert len({x for x in joined if x <= {1, 2, 3}}) == 2


def test_components_of_a_chain_take_few_rounds(spark, monkeypatch):
    from tidemark.llm import components

    calls, real = [], components.durable
    monkeypatch.setattr(components, "durable", lambda df, name: (calls.append(name), real(df, name))[1])
    edges = spark.createDataFrame([(i, i + 1) for i in range(2000)] + [(5000, 5000), (7001, 7000)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {**dict.fromkeys(range(2001), 0), 7000: 7000, 7001: 7000} and len(calls) < 30
    assert components.components(edges.limit(0)).count() == 0


def test_one_of_each_decides_by_row(spark):
    other = "something else entirely that is long enough to be a text of its own with many words in it " * 2
    rows = [(None, BASE, "a"), (7, BASE + " extra", "b"), (7, other, "c"), (9, BASE, "d"), (9, BASE, "d"), (None, other + "x", "e"), (None, None, "f"), (None, "", "g"), (3, None, "h"), (None, "lone text", "i"), (None, "lone text", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone string")
    kept = sorted((str(r.doc_id), str(r.text)[:9], r._gone) for r in jaccard_join.one_of_each(docs).collect())
    want = [(None, None, "f"), (None, "", "g"), (3, None, "h"), (7, BASE + " extra", "b"), (7, other, "c"), (None, "lone text", "i")]
    assert kept == sorted((str(i), str(t)[:9], g) for i, t, g in want)


def test_one_of_each_leaves_texts_where_they_are_if_few_rows_stay(spark, monkeypatch):
    """What goes is too much to broadcast (here: more than 20 rows), what stays isn't."""
    from tidemark.llm import common

    texts = [f"{BASE} text{i % 3} " * 2 for i in range(60)] + [None, None, "", "lone text"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "", "y"), (63, "lone text", "z")], "doc_id long, text string, _stay string")
    want = sorted((str(r.doc_id), str(r.text)) for r in jaccard_join.one_of_each(docs).collect())
    small = common.small_enough
    for module in (common, jaccard_join):
        monkeypatch.setattr(module, "small_enough", lambda df, most=20: small(df, 20))
    kept = jaccard_join.one_of_each(docs)
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == want and len(want) < 10
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "strategy=broadcast" in plan


def test_trie_finds_what_comparing_all_finds():
    random = np.random.default_rng(5)
    for _ in range(30):
        base = random.choice(300, 40, replace=False)
        sets = [sorted(set(np.where(random.random(40) < 0.08, random.integers(300, 500, 40), base).tolist())) for _ in range(12)]
        members = [(i, len(s), s) for i, s in enumerate(sets)]
        want, got = list(range(12)), list(range(12))
        pairs = [(a, b) for a in range(12) for b in range(a) if 100 * len({*sets[a]} & {*sets[b]}) >= 80 * len({*sets[a]} | {*sets[b]})]
        for parent, found in ((want, pairs), (got, jaccard_join.trie_links(members, members, 80))):
            for _ in range(12):
                for a, b in found:
                    parent[a] = parent[b] = min(parent[a], parent[b])
        assert want == got


def test_motion_jpeg_round_trip(spark, docs):
    got = motion_jpeg.digests(motion_jpeg.store_texts(docs)).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        if r.doc_id is not None:
            p = (TEXTS[r.doc_id] or "").encode()
            full = p + b" " * (max(1, -(-len(p) // 192)) * 192 - len(p))
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), len(full), sha256(full).hexdigest(), crc32(full[-16:]))
    clips = motion_jpeg.clips(motion_jpeg.store_texts(docs)).where("doc_id = 11").orderBy("clip").collect()
    assert clips[0].first_frame == 0 and all(a.end_s == b.start_s for a, b in zip(clips, clips[1:]))
    broken = spark.createDataFrame([(1, None), (2, bytearray(b"RIFFxxxxAVI LIST")), (3, bytearray(b""))], "doc_id long, media binary")
    assert motion_jpeg.clips(broken).count() == 0


def test_jpeg_decoding_with_runs_and_ends_of_block():
    """A frame of two flat blocks and one with a run, coded by hand: DC classes 0, 4 and AC symbols end of block and (run 2, size 1)."""
    dc, ac = bytes([0, 2, *[0] * 14, 0, 4]), bytes([0, 2, *[0] * 14, 0x00, 0x21])
    segment = motion_jpeg._segment
    head = b"\xff\xd8" + segment(0xDB, b"\0" + b"\1" * 64) + segment(0xC0, b"\x08\0\x08\0\x18\1\1\x11\0") + segment(0xC4, b"\0" + dc) + segment(0xC4, b"\x10" + ac) + segment(0xDA, b"\1\1\0\0\x3f\0")
    bits = "01" + "1010" + "00" + "00" + "00" + "01" + "0101" + "01" + "1" + "00"  # +10, end; same, end; -10, one after two zeros, end
    bits += "1" * (-len(bits) % 8)
    frame = head + int(bits, 2).to_bytes(len(bits) // 8, "big") + b"\xff\xd9"
    ((h, c),) = motion_jpeg.decode([frame])
    assert c[:, 0].tolist() == [10, 10, 0] and c[2, 3] == 1 and np.count_nonzero(c) == 3
    assert (motion_jpeg.samples(c[:1], h.quantiser[0]) == 129).all()
    assert motion_jpeg.decode([b"junk"]) == [None]


def test_shots_are_cut_where_histograms_change():
    shares = np.zeros((20, motion_jpeg.BINS))
    shares[:12, 3], shares[12:, 20] = 1, 1
    assert motion_jpeg.cuts(shares) == [0, 12] and motion_jpeg.cuts(shares[:0]) == []


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, BASE), (2, "nothing of this kind is anywhere at all"), (3, None), (4, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(docs, items).collect()}
    assert set(got) == {(i, 1) for i in (6, 7, 8, 9)} and got[6, 1] == 1
    edited = BASE.split()
    edited[7], edited[20] = "changed", "x y"
    one = spark.createDataFrame([(5, "before that " + " ".join(edited).upper() + " after")], "doc_id long, text string")
    assert 0.8 < decontaminate.contaminated(one, items).first().score < 1
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0 and decontaminate.contaminated(docs.limit(0), items).count() == 0


def test_decontamination_finds_all_that_alignment_finds(spark):
    random, words = np.random.default_rng(3), [f"v{i}" for i in range(300)]
    items = [" ".join(random.choice(words, n)) for n in (60, 40, 25, 12, 7, 4, 3, 2, 1)]

    def edited(text, every, kind):
        out = []
        for i, w in enumerate(text.split(), 1):
            out += [w] if i % every or kind == "insert" else []
            out += ["edit"] if not i % every and kind != "delete" else []
        return " ".join(out)

    texts = [edited(t, k, kind) for t in items for k in (1, 2, 3, 4, 5, 6) for kind in ("insert", "replace", "delete")]
    texts = [" ".join(random.choice(words, 30)) + f" {t} " + " ".join(random.choice(words, 30)) for t in texts] + [" ".join(random.choice(words[:40], 200)) for _ in range(40)]
    texts += [t for t in items for _ in range(2)]  # whole copies make the unedited words more common than the edited
    ids = {w: i + 10 for i, w in enumerate(sorted({w for t in texts + items for w in t.split()}))}
    number = lambda t: np.array([ids[w] for w in t.split()], np.uint64)
    want = {}
    for j, item in enumerate(items):
        for i, score in enumerate(decontaminate.align([number(item)] * len(texts), [number(t) for t in texts])[0]):
            if score >= 0.5:
                want[i, j] = score
    rows = lambda x, name: spark.createDataFrame(list(enumerate(x)), f"{name} long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(rows(texts, "doc_id"), rows(items, "item_id")).collect()}
    assert got == want and len(want) > 100


def test_decontamination_in_blocks_and_by_parts_of_items(spark, monkeypatch):
    """Several blocks of items, some of them equal, and a long text full of a line that all items have: the same rows."""
    random = np.random.default_rng(13)
    words, line = [f"v{i}" for i in range(500)], "all the items have this very line"
    items = [(i, " ".join(random.choice(words, 12)) + " " + line) for i in range(60)] + [(60, line + " once"), (61, line + " once")]
    texts = [(0, f"{line} " * 400)] + [(i, "before " + t.replace("v1", "w1") + " after") for i, t in items[:20]] + [(None, items[3][1]), (30, ""), (31, None)]
    rows = lambda x, name: spark.createDataFrame(x, f"{name} long, text string")
    found = []
    for size, places in ((8 << 20, 1 << 20), (1500, 50)):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        found.append(sorted((str(r.doc_id), r.item_id, r.score, r.end_word) for r in decontaminate.contaminated(rows(texts, "doc_id"), rows(items, "item_id")).collect()))
        seeds = decontaminate.Seeds([t for _, t in items], [i for i, _ in items], 0.5)
        doc, words_of = decontaminate._read(pa.record_batch([pa.array([t for _, t in texts])], names=["text"]))
        monkeypatch.setattr(decontaminate, "_PLACES", places)
        found.append(sorted(x for w in seeds.windows(doc, words_of) for x in zip(*(c.tolist() for c in w))))
    assert found[0] == found[2] and found[1] == found[3] and ("None", 3, 1.0, 19) in found[0] and {r[1] for r in found[0] if r[0] == "0"} >= {60, 61}


def test_decontamination_without_spaces(spark):
    random = np.random.default_rng(14)
    han = lambda n: "".join(chr(0x4E00 + i) for i in random.integers(0, 3000, n))
    item = han(30)
    texts = [han(40) + item + han(40), han(20) + item[:9] + "ひ" + item[10:19] + item[20:] + "。", han(110), item[:10] + han(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (round(r.score, 3), r.end_word) for r in decontaminate.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {0: (1.0, 70), 1: (round((28 * 2 - 2) / 60, 3), 49)}


def test_alignment_is_smith_waterman():
    random = np.random.default_rng(2)
    a, b = [random.integers(0, 6, n).astype(np.uint64) + 10 for n in (9, 12)], [random.integers(0, 6, n).astype(np.uint64) + 10 for n in (20, 15)]
    for x, y, got in zip(a, b, decontaminate.align(a, b)[0]):
        h = np.zeros((len(x) + 1, len(y) + 1))
        for i in range(len(x)):
            for j in range(len(y)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if x[i] == y[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert got == h.max() / (2 * len(x))


def test_language(spark, docs, real):
    model = language.learn(real)
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2, 12)) and all(0 <= r.score <= 1 for r in got.values())
    both = real.where("n_chars > 800 and lang in ('en', 'de')").dropDuplicates(["lang"]).collect()
    mixed = spark.createDataFrame([(1, both[0].text[:800] + " " + both[1].text[:800])], "doc_id long, text string")
    share = language.predict(mixed, model).first().mixture
    assert set(share) == {"en", "de"} and all(0.3 < x < 0.7 for x in share.values())
    found = language.predict(real, model).join(real, "doc_id")
    assert found.where("lang_pred = lang").count() > 0.97 * real.count()
    assert language.predict(docs, language.learn(docs.limit(0))).where("lang_pred <> 'und'").count() == 0


@pytest.mark.parametrize("kind", [toxicity, quality])
def test_labelled_scores(spark, docs, kind):
    bad = "this is a horrid vile text" if kind is toxicity else "### %%% | | ### %%%"
    rows = [(i, f"plain words number {i % 7} of a calm page " * 3 + (bad if i % 2 else ""), i % 2) for i in range(400)]
    train = spark.createDataFrame(rows, "doc_id long, text string, label int")
    labels = train.selectExpr("doc_id", "label as toxic").unionByName(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int"))
    model = kind.learn(toxicity.training(train, labels, "toxic"))
    got = kind.score(train.selectExpr("doc_id", "text", "label as score"), model).join(train, "doc_id").collect()
    assert all((r.score >= 0.5) == r.label for r in got)
    edge = kind.score(docs, model).collect()
    assert len(edge) == len(TEXTS) + 2 and all(0 <= r.score <= 1 for r in edge)
    none = kind.learn(toxicity.training(train.limit(0), labels, "toxic"))
    assert all(r.score == 0.5 for r in kind.score(docs, none).collect())


def kneser_ney_by_force(texts, labels):
    """log P(text's symbols | toxic) - log P(. | ordinary), by dictionaries of symbol strings."""
    import unicodedata

    def symbol(c):
        if c.isspace() or c == "\0":
            return " "
        if c.isalpha():
            base = unicodedata.normalize("NFD", c)[0].lower() if ord(c) > 127 else c.lower()
            return base if "a" <= base <= "z" else c
        return "0" if c.isdigit() else "."

    def grams(text):
        t = re.sub(" +", " ", "".join(map(symbol, text.lower())) + " ")
        t = t[1:] if t.startswith(" ") and len(t) > 1 else t
        t = "    " + t if t.strip() else ""
        return [t[i : i + 5] for i in range(len(t) - 4)]

    counts = [{}, {}]
    for t, y in zip(texts, labels):
        for g in grams(t):
            counts[y][g] = counts[y].get(g, 0) + 1
    left = [None] * 5  # of each length, the contexts to the left of its grams
    level = {*counts[0], *counts[1]}
    for k in (4, 3, 2, 1):
        n = {}
        for g in level:
            n[g[1:]] = n.get(g[1:], 0) + 1
        left[k], level = n, set(n)

    def shared(g):
        if not g:
            return 1 / (len(left[1]) + 1)
        total = sum(n for x, n in left[len(g)].items() if x[:-1] == g[:-1])
        kinds = sum(x[:-1] == g[:-1] for x in left[len(g)])
        lower = shared(g[1:])
        return (max(left[len(g)].get(g, 0) - 0.75, 0) + 0.75 * kinds * lower) / total if total else lower

    def of_class(g, n):
        total, kinds, lower = sum(v for x, v in n.items() if x[:4] == g[:4]), sum(x[:4] == g[:4] for x in n), shared(g[1:])
        return (max(n.get(g, 0) - 0.75, 0) + 0.75 * kinds * lower) / total if total else lower

    return lambda text: [float(np.log(of_class(g, counts[1])) - np.log(of_class(g, counts[0]))) for g in grams(text)]


def test_toxicity_is_kneser_ney_by_force(spark):
    texts = ["you vile thing", "a calm day, 2 birds", "vile vile words", "été et été", "day by day", "Привет you"]
    labels = [1, 0, 1, 0, 0, 1]
    rows = spark.createDataFrame(list(zip(texts, labels)), "text string, label int")
    table = toxicity.Lookup(*toxicity.packed(toxicity.ratios(toxicity.gram_counts(rows))))
    force = kneser_ney_by_force(texts, labels)
    for t in [*texts, "vile day", "unseen zebra!", "", "  a  b "]:
        want, got = force(t), toxicity.features(pa.array([t]), table)[0]
        total = np.append(0, np.cumsum(want))
        assert got[0] == pytest.approx(np.mean(want) if want else 0, abs=2e-3)
        for w, x in zip(toxicity.WINDOWS, got[1:]):
            best = max((total[min(i + w, len(want))] - total[i]) / w for i in range(len(want))) if want else 0
            assert x == pytest.approx(best, abs=2e-3)


def test_curve_rows_are_a_fifth_or_few(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "'text' as text")
    labels = docs.selectExpr("doc_id", "int(doc_id % 2) as toxic").unionByName(docs.limit(5).selectExpr("doc_id", "1 as toxic"))
    for most, low, high in ((20_000, 600, 1000), (200, 130, 280)):
        rows = toxicity.labelled_rows(docs, labels, "toxic", most)
        assert low < rows.where("fold = 0").count() < high and rows.count() == 4000
    assert rows.where("doc_id < 5 and label = 1").count() == 5


def test_language_mixture_is_the_best_penalised_set(spark):
    """EM to convergence over all sets of languages, by plain loops, against the operator's choice."""
    random = np.random.default_rng(7)
    words = {"aa": "lorem ipsum dolor", "bb": "quick brown foxes", "cc": "zwölf große jäger", "dd": "gato perro pájaro"}
    train = spark.createDataFrame([(t * 20, k) for k, t in words.items()] + [("nothing", None)], "text string, lang string")
    model = language.learn(train)
    texts = [" ".join(random.choice(" ".join(words[k] for k in ks).split(), 12)) for ks in (["aa"], ["aa", "bb"], ["cc", "dd"], ["bb", "cc", "dd"], ["dd"], ["aa", "bb", "cc", "dd"]) for _ in range(4)]
    got = {r.doc_id: r for r in language.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    agree = 0
    for i, t in enumerate(texts):
        _, bucket = language.trigrams(pa.array([t]))
        key, count = np.unique(bucket, return_counts=True)
        p = np.exp(model.log[:, key].astype(float))
        best = None
        for subset in range(1, 16):
            ks = [k for k in range(4) if subset >> k & 1]
            pi = np.full(len(ks), 1 / len(ks))
            for _ in range(300):
                part = pi[:, None] * p[ks]
                pi = (part / part.sum(0) * count).sum(1)
                pi /= pi.sum()
            value = (count * np.log((pi[:, None] * p[ks]).sum(0))).sum() - (len(ks) - 1) / 2 * np.log(count.sum())
            if best is None or value > best[0] + 1e-6:
                best = value, ks, pi
        want = {model.names[k]: x for k, x in zip(best[1], best[2])}
        same = set(got[i].mixture) == set(want)
        agree += same
        if same:
            assert all(abs(got[i].mixture[k] - x) < 0.03 for k, x in want.items())
        assert got[i].lang_pred == max(want, key=want.get) or sorted(want.values())[-1] - sorted(want.values())[-2] < 0.05
    assert agree >= len(texts) - 1  # the operator tries the sets of the most present languages, not all


def test_sets_of_many_languages_are_those_of_all_sizes():
    """The bound that ends the search loses nothing: against every size of set, in turn, by plain loops."""
    random, k = np.random.default_rng(5), 16
    words = [["".join(random.choice(list("abcdefghijklmnop"), 5, p=p)) for _ in range(60)] for p in random.dirichlet(np.ones(16), k)]
    say = lambda j, n: " ".join(random.choice(words[j], n))
    counts = np.stack([np.bincount(language.trigrams(pa.array([say(j, 800)]))[1], minlength=language.BUCKETS) for j in range(k)]).astype(float)
    model = language.Mixture([str(j) for j in range(k)], counts)
    texts = [" ".join(say(j, 30) for j in random.choice(k, size, False)) for size in (1, 1, 2, 2, 3, 4, 6, 9, 16) for _ in range(2)]
    got, has, _ = model.infer(pa.array([*texts, None, ""]))
    assert has.tolist() == [True] * len(texts) + [False] * 2
    sizes = set()
    for t, share in zip(texts, got):
        key, count = np.unique(language.trigrams(pa.array([t]))[1], return_counts=True)
        log, step = model.log[:, key].astype(float), 0.5 * np.log(count.sum())

        def fit(ks, rounds):
            pi = np.full(len(ks), 1 / len(ks))
            for _ in range(rounds):
                part = pi[:, None] * np.exp(log[ks])
                pi = (part / part.sum(0) * count).sum(1) / count.sum()
            return pi, (count * np.log((pi[:, None] * np.exp(log[ks])).sum(0))).sum()

        order = np.argsort(-fit(np.arange(k), 10)[0], kind="stable")
        single = (log * count).sum(1)
        first = (single + model.prior).argmax()
        best = single.max(), {first: 1.0}
        for m in range(2, k + 1):
            pi, value = fit(order[:m], 25)
            if value - (m - 1) * step > best[0]:
                best = value - (m - 1) * step, dict(zip(order[:m], pi))
        assert set(np.flatnonzero(share)) == set(best[1]) and all(abs(share[j] - x) < 1e-3 for j, x in best[1].items())
        sizes.add(len(best[1]))
    assert len(sizes) > 4


def test_dual_descent_is_the_hinge_loss_minimum():
    """Against gradient descent on the primal problem."""
    random = np.random.default_rng(9)
    ratio, rows = random.normal(size=30), [np.sort(random.choice(30, 8, replace=False)) for _ in range(60)]
    y = np.where([ratio[r].sum() + random.normal() > 0 for r in rows], 1, -1)
    w, b = quality.dual_descent(rows, y, ratio, rounds=2000)
    x = np.zeros((60, 31))
    for i, r in enumerate(rows):
        x[i, r], x[i, 30] = ratio[r] / np.linalg.norm(ratio[r]), 1
    weight = np.where(y > 0, 60 / (2 * (y > 0).sum()), 60 / (2 * (y < 0).sum()))
    v = np.zeros(31)
    for _ in range(20_000):
        slack = np.maximum(0, 1 - y * (x @ v))
        v -= 0.005 * (v - 2 * x.T @ (weight * slack * y))
    loss = lambda u: 0.5 * u @ u + (weight * np.maximum(0, 1 - y * (x @ u)) ** 2).sum()
    assert loss(np.append(w, b)) == pytest.approx(loss(v), rel=1e-3) and np.allclose(np.append(w, b), v, atol=0.02)


def test_log_ratios_are_those_of_document_counts(spark):
    texts, labels = ["ab ab", "ab cd", "cd", "", "ab"], [1, 1, 0, 0, 0]
    rows = spark.createDataFrame(list(zip(texts, labels)), "text string, label int")
    got = quality.log_ratios(quality.class_counts(rows))
    each = [set(quality.indicators(pa.array([t]))[1].tolist()) for t in texts]
    for k in set().union(*each):
        n = [sum(k in s for s, y in zip(each, labels) if y == c) for c in (0, 1)]
        assert got[k] == pytest.approx(np.log(((n[1] + 1) / (2 + 2)) / ((n[0] + 1) / (3 + 2))))


def shots_by_force(shares):
    """First frames of shots, one frame after the other."""
    found, since = [0], 0
    for t in range(1, len(shares)):
        d = sum(abs(a - b) for a, b in zip(shares[t], shares[t - 1])) / 2
        before = [sum(abs(a - b) for a, b in zip(shares[i], shares[i - 1])) / 2 for i in range(max(since + 1, t - 12), t)]
        mean = sum(before) / len(before) if before else 0
        limit = mean + 3 * (sum((x - mean) ** 2 for x in before) / len(before)) ** 0.5 if before else 0.5
        if d > max(0.08, limit):
            found.append(t)
            since = t
    return found


def test_shots_of_stored_texts_by_force(spark):
    """Frames of 12,288 bytes with changing kinds of bytes: histograms from the bytes themselves, and all shots told."""
    kinds = ["aeiou", "AEIOU", "0123456789", "{|}~", "    !", "MNOPQ", "é", "xyz"]
    random = np.random.default_rng(10)
    text = "".join("".join(random.choice(list(kinds[(i // 3) % 8]), 12_288 if kinds[(i // 3) % 8] != "é" else 6_144)) for i in range(40))
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    got = {r.doc_id: r for r in motion_jpeg.digests(motion_jpeg.stored(motion_jpeg.store_texts(docs))).collect()}
    media = {r.doc_id: bytes(r.media) for r in motion_jpeg.store_texts(docs).collect()}
    rate, places = motion_jpeg.frames_of(media[1])
    shares = motion_jpeg.histograms(motion_jpeg.decode([media[1][a : a + n] for a, n in places]))
    want = shots_by_force(shares.tolist())
    at = [int(x) for x in re.search(r"at=([\d.]+);", got[1].feature)[1].split(".")]
    assert at == want and len(want) > 8
    assert [(c.first_frame, c.start_s) for c in got[1].clips] == [(f, f / rate) for f in want] and got[1].clips[-1].end_s == len(places) / rate
    assert [tuple(c) for c in got[2].clips] == [(0, 1, 0.0, 1 / rate)]


def test_shared_model_is_a_distribution(spark):
    counts = toxicity.gram_counts(spark.createDataFrame([("some text, and another text of 7 words", 1), ("été 你好 some more of it", 0)], "text string, label int"))
    rows = toxicity.shared_model(counts).collect()
    seen = {}
    for r in rows:
        seen[r.g[:3]] = seen.get(r.g[:3], 0) + r.p
    assert all(0 < x < 1 for x in seen.values()) and len(rows) == len({r.g for r in rows})


def test_lookup_holds_all_keys():
    random = np.random.default_rng(2)
    keys = np.unique(random.integers(0, 1 << 64, 5000, np.uint64, endpoint=False))
    keys[:200] = (keys[0] & ~np.uint64(0xFFFFFFFF)) + np.arange(200, dtype=np.uint64) * np.uint64(2)  # one slot
    table = toxicity.Lookup(keys.view(np.int64), np.arange(len(keys)).astype(np.float16))
    got, has = table.find(keys)
    assert has.all() and np.array_equal(got, np.arange(len(keys)).astype(np.float16))
    assert not table.find(random.integers(0, 1 << 64, 5000, np.uint64, endpoint=False))[1].any()
    assert not toxicity.Lookup(np.zeros(0, np.int64), np.zeros(0, np.float16)).find(keys)[1].any()


def test_toxicity_by_a_join_is_the_same(spark, docs, monkeypatch):
    rows = [(i, f"plain words number {i % 7} of a calm page " * 3 + ("vile words" if i % 2 else "")) for i in range(300)]
    train = spark.createDataFrame(rows, "doc_id long, text string")
    labels = train.selectExpr("doc_id", "int(doc_id % 2) as toxic")
    asked = docs.select("doc_id", "text").unionByName(train)
    found = []
    for most in (toxicity.TABLE_GRAMS, 0):
        monkeypatch.setattr(toxicity, "TABLE_GRAMS", most)
        monkeypatch.setattr(toxicity, "ASKING_BYTES", 100_000)
        model = toxicity.learn(toxicity.training(train, labels, "toxic"))
        assert (model.small is None) == (most == 0)
        found.append(sorted((str(r.doc_id), round(r.score, 6)) for r in toxicity.score(asked, model).collect()))
    assert found[0] == found[1] and len(found[0]) == len(TEXTS) + 302


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    got = token_files.token_output(docs, tokenizer_path()).orderBy("start").collect()
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for r, (i, text) in zip(got, rows, strict=True):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), crc32(ids.tobytes()))
        at += len(ids)
    assert token_files.token_output(docs.limit(0), tokenizer_path()).count() == 0
    files = token_files.write_tokens(docs, tokenizer_path(), token_files.fresh_path(spark, "tokens"), file_ids=5)  # many files a part
    again = token_files.read_tokens(files).orderBy("start").collect()
    assert files.groupBy("part").count().agg(F.max("count")).first()[0] > 3 and [tuple(r) for r in again] == [tuple(r) for r in got]


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 70_000])
def test_packing(n):
    random = np.random.default_rng(n)
    ids = random.integers(0, 300, n).astype(np.uint32)
    ids[random.random(n) < 0.05] = 2**31
    assert np.array_equal(token_files.unpack(*token_files.pack(ids), n), ids)


@pytest.mark.parametrize("weights", [[1, 2], [1, 3.141592653589793], [1, 10_000], [5, 3, 1, 1], [0.7, 0.2, 1e-6, 11, 0.3333], [1] * 40])
def test_pfair_stays_within_a_block_of_the_target(weights):
    shares = mixing.Shares([mixing.as_fraction(w) for w in weights])
    target = [Fraction(str(w)) / sum(Fraction(str(x)) for x in weights) for w in weights]
    done = [0] * len(weights)
    for t, (s, j) in enumerate(shares.slots(0, 90_000, list(done)), 1):
        assert j == done[s] and shares.release(s, j) < t <= shares.deadline(s, j)
        done[s] += 1
        assert all(abs(done[x] - target[x] * t) < 1 for x in (range(len(weights)) if t % 64 == 0 else [s]))
        assert t % shares.total or all(n == w * t for n, w in zip(done, target))


def test_phases_send_all_blocks_of_many_sources():
    weights = {f"s{i}": Fraction(1 + i * 37 % 64, 64) for i in range(2000)}
    blocks = {f"s{i}": 1 + i * 7919 % 400 for i in range(2000)}
    plan = mixing.phases(blocks, weights)
    assert sum(stop for _, stop, _, _ in plan) == sum(blocks.values()) and len(plan) <= 2000
    with pytest.raises(ValueError, match="positive"):
        mixing.Shares([Fraction(0), Fraction(1)])


def order_by_force(blocks, weights):
    """(source, block) slot by slot, from the contract alone: released blocks by deadline, and all anew for those left when a source has ended. Checks that each source
    alive has less than one block more or fewer than its share since then, at every slot."""
    done, out = dict.fromkeys(blocks, 0), []
    while left := sorted(s for s in blocks if done[s] < blocks[s]):
        total, sent = sum(weights[s] for s in left), dict.fromkeys(left, 0)
        share, t = {s: weights[s] / total for s in left}, 0
        while all(done[s] + sent[s] < blocks[s] for s in left):
            s = min((s for s in left if sent[s] / share[s] < t + 1), key=lambda s: (-((-sent[s] - 1) / share[s] // 1), left.index(s)))
            out.append((s, done[s] + sent[s]))
            sent[s], t = sent[s] + 1, t + 1
            assert all(abs(sent[x] - share[x] * t) < 1 for x in left)
        for s in left:
            done[s] += sent[s]
    return out


def test_sources_that_end_at_any_time(spark, monkeypatch):
    """Also the mix of one large source and 40 small ones; the order is the same for any stretch."""
    random = np.random.default_rng(3)
    cases = [({"big": 400, **{f"s{i:02}": 2 + i % 10 for i in range(40)}}, {"big": 60, **{f"s{i:02}": 1 for i in range(40)}})]
    for _ in range(6):
        names = [f"s{i:02}" for i in range(random.integers(2, 25))]
        cases.append(({s: int(random.integers(1, 60)) for s in names}, {s: int(random.integers(1, 64)) for s in names}))
    for stretch in (4096, 7):
        monkeypatch.setattr(mixing, "STRETCH", stretch)
        for blocks, weights in cases:
            given = {s: Fraction(w) for s, w in weights.items()}
            plan, got = mixing.phases(blocks, given), []
            for done, stop, stretches, states in plan:
                left = [(s, k) for s, k in zip(sorted(blocks), done.tolist()) if k < blocks[s]]
                shares = mixing.Shares([given[s] for s, _ in left])
                got += [(left[i][0], left[i][1] + j) for k in range(stretches) for i, j in shares.stretch_slots(k, stop, states)]
            assert got == order_by_force(blocks, given)


@pytest.mark.parametrize("weights", [{"a": 1, "b": 2}, {"a": 3.141592653589793, "b": 1.0}, {"a": 0.25, "c": 10}])
def test_mixing_is_what_one_slot_after_the_other_gives(spark, monkeypatch, weights):
    monkeypatch.setattr(mixing, "STRETCH", 50)
    sizes = {"a": 900, "b": 501, "c": 37, "d": 3, "": 1}
    rows = spark.createDataFrame([(i, s or None) for s, n in sizes.items() for i in range(n)], "doc_id long, source string")
    got = mixing.mix(rows, weights, 4).collect()
    given = {s: mixing.as_fraction(weights[s]) if s in weights else Fraction(max(1, round(64 * n**0.5 / (sum(k**0.5 for k in sizes.values()) / 5))), 64) for s, n in sizes.items()}
    want, position = {}, 0
    for s, j in order_by_force({s: -(-n // 4) for s, n in sizes.items()}, given):
        want[s, j] = position
        position += min(4, sizes[s] - 4 * j)
    assert sorted(r.position for r in got) == list(range(sum(sizes.values()))) and len({r.slot for r in got}) == len(want)
    assert want == {k: min(r.position for r in got if (r.source, r.block) == k) for k in want}


def test_mixing(spark, docs, real):
    got = mixing.mix(real, {"src0": 3.0}, 4).orderBy("position").collect()
    assert [r.position for r in got] == list(range(real.count())) and {r.doc_id for r in got} == {r.doc_id for r in real.collect()}
    assert [r.slot for r in got] == sorted(r.slot for r in got)
    edge = mixing.mix(docs, block_docs=2).collect()
    assert sorted(r.position for r in edge) == list(range(len(TEXTS) + 2)) and "" in {r.source for r in edge}
    assert mixing.mix(docs.limit(0)).count() == 0


def test_warc(spark, monkeypatch):
    inner = warc.record(99, "http://inner/", b"fake", "0" * 40, None, "2024-01-01T00:00:00Z").decode()
    long = "x" * 2000
    rows = [(1, "http://a b/\n", long, "clash"), (2, None, long, None), (3, "u", None, None), (4, "u", "short", None), (5, "u", "short", None), (6, "u", inner * 3 + "WARC/1.0\r\n", None), (None, "u", "no id", None), (7, "u", "é" * 900 + inner, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(2)
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert len(got) == len(rows)
    for i, _, html, _ in rows:
        data = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), sha1(data).hexdigest())
    assert (got[1].record_type, got[1].refers_to) == ("revisit", 2) and got[4].record_type == got[2].record_type == "response"
    assert warc.round_trip(pages.limit(0)).count() == 0
    monkeypatch.setattr(warc, "SPLIT_BYTES", 700)  # many splits: the chain has to jump between them
    assert warc.round_trip(pages).count() == len(rows)


def test_warc_with_too_many_repeats_to_broadcast(spark, monkeypatch):
    rows = [(i, f"http://h/{i}", "x" * (1000 + i % 3)) for i in range(60)] + [(None, "u", "x" * 1000), (59, "again", "x" * 1002)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = []
    for most in (warc.BROADCAST_DIGESTS, 0):
        monkeypatch.setattr(warc, "BROADCAST_DIGESTS", most)
        found.append(sorted((str(r.page_id), r.url, r.record_type, r.refers_to, r.payload_digest) for r in warc.round_trip(pages).collect()))
    assert found[0] == found[1] and sum(x[2] == "response" for x in found[0]) == 4  # the largest id is there twice


def test_warc_hashes_only_what_is_reached(spark, monkeypatch, tmp_path):
    """A payload full of heads that all claim the rest of it, and an archive that is cut off."""
    head = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: {:07d}\r\n\r\n"
    each, n = len(head.format(0)), 400
    inner = "\r\n\r\n" + "".join(head.format((n - i - 1) * each + 9) for i in range(n)) + "some text\r\n\r\n"
    pages = spark.createDataFrame([(1, "u", inner), (2, "v", "after it")], "page_id long, url string, html string").repartition(1)
    files = warc.write_archives(warc.with_revisits(pages), f"file://{tmp_path}")
    assert warc.candidates(files).count() > n
    for split in (warc.SPLIT_BYTES, 3000):
        monkeypatch.setattr(warc, "SPLIT_BYTES", split)
        got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.read_archives(files).collect()}
        assert got == {1: (len(inner), sha1(inner.encode()).hexdigest()), 2: (8, sha1(b"after it").hexdigest())}
    path, size, _ = files.first()
    with open(path.removeprefix("file://"), "r+b") as f:
        f.truncate(size - 3)
    cut = spark.createDataFrame([(path, size - 3)], "path string, bytes long")
    assert len({r.page_id for r in warc.read_archives(cut).collect()}) == 1


def test_warc_with_long_heads(spark, monkeypatch):
    rows = [(1, "http://a/" + "x" * 200_000, "first"), (2, "http://b/", "second"), (3, "http://c/" + " " * 30_000, "third"), (4, "http://d/" + "WARC/1.1\r\n" * 20_000, "fourth"), (5, "u", "last")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1)
    want = {(i, url.replace(" ", "%20").replace("\r", "%0D").replace("\n", "%0A"), len(html)) for i, url, html in rows}
    for split in (warc.SPLIT_BYTES, 70_000):
        monkeypatch.setattr(warc, "SPLIT_BYTES", split)
        got = warc.round_trip(pages).collect()
        assert len(got) == len(rows) and {(r.page_id, r.url, r.payload_bytes) for r in got} == want
    real = warc.read_archives
    monkeypatch.setattr(warc, "read_archives", lambda files: real(files).where("page_id <> 2"))
    with pytest.raises(ValueError, match="records"):
        warc.round_trip(pages)


def test_url_filter(spark):
    day = lambda rows, schema: spark.createDataFrame(rows, schema)
    entries = day([("x.com", "block", "2024-02-01"), ("x.com", None, "2024-03-01"), ("a.x.com/p/", "allow", "2024-01-01"), (None, "block", "2024-01-01")], "key string, verdict string, dated string").selectExpr("key", "verdict", "to_date(dated) as dated")
    rows = [(1, "http://A.x.com/q", "2024-02-01"), (2, "http://a.x.com/p/z?q", "2024-02-02"), (3, "http://a.x.com/", "2024-03-01"), (4, "http://notx.com/", "2024-02-02"), (5, None, "2024-02-02"), (6, "junk", None), (1, "http://A.x.com/q", "2024-02-01")]
    captures = day(rows, "id long, url string, fetched string").selectExpr("id", "url", "to_date(fetched) as fetched", "'old' as verdict")
    want = [(1, "block"), (1, "block"), (2, "allow"), (3, None), (4, None), (5, None), (6, None)]
    assert sorted(((r.id, r.verdict) for r in url_filter.verdicts(captures, entries).collect()), key=str) == sorted(want, key=str)
    assert url_filter.verdicts(captures.limit(0), entries).count() == 0 and url_filter.verdicts(captures, entries.limit(0)).where("verdict is not null").count() == 0


@pytest.mark.parametrize("most", [500_000, 0])
def test_url_filter_against_force(spark, monkeypatch, most):
    """Odd URLs, many dates of one key, same-day entries and a hot URL, against a plain loop; with the list broadcast and shuffled."""
    monkeypatch.setattr(url_filter, "BROADCAST_INTERVALS", most)
    random = np.random.default_rng(8)
    keys = ["evil.com", "a.evil.com", "x.org", "x.org/p/", "x.org/p/q/", "EVIL.com.", "deep.x.org/"]
    rows = [(keys[i], [None, "block", "allow", "review"][v], int(d)) for i, v, d in zip(random.integers(0, len(keys), 600), random.integers(0, 4, 600), random.integers(0, 200, 600))]
    rows += [(None, "block", 5), ("x.org", "block", None), ("same.net", "block", 10), ("same.net", None, 10), ("same.net", "allow", 50)]
    entries = spark.createDataFrame(rows, "key string, verdict string, d int").selectExpr("key", "verdict", "date_add(date'2024-01-01', d) as dated")
    urls = {
        "http://user:pw@evil.com/": "evil.com", "http://evil.com./": "evil.com", " http://evil.com/\n": "evil.com", "HTTPS://A.Evil.com:8080/z": "a.evil.com", "http://notevil.com/": "notevil.com",
        "http:\\\\evil.com\\p": "evil.com", "http://x.org/p/q/r?u=/s/": "x.org", "http://x.org?/p/": "x.org", "http://x.org/p#/q/": "x.org", "http://deep.x.org/": "deep.x.org", "http://deep.x.org": "deep.x.org",
        "http://x.org:80@evil.com:90/p/": "evil.com", "http://[::1]:80/": "[::1]", "junk": "", "": "", "http://": "", "http://same.net/": "same.net", "http://x.org/" + "p/" * 30_000: "x.org", "http://" + "a." * 5000 + "x.org/p/": "a." * 5000 + "x.org",
    }
    asked = [(u, int(d)) for u in urls for d in random.integers(0, 210, 6)] + [(None, 3), ("http://evil.com/", None)] + [("http://evil.com/hot", 77)] * 3000 + [("http://same.net/", 10), ("http://same.net/", 50)]
    urls["http://evil.com/hot"] = "evil.com"
    captures = spark.createDataFrame([(i, u, d, "clash", 7) for i, (u, d) in enumerate(asked)], "id long, url string, d int, matched_key string, _rows2 int").withColumn("fetched", F.expr("date_add(date'2024-01-01', d)"))
    days = {}
    for k, v, d in rows:
        if k and d is not None:
            days.setdefault(k.lower().rstrip("."), {}).setdefault(d, []).append(v)

    def expected(u, d):
        if u is None or d is None or not urls.get(u):
            return None, None
        path = re.sub(r"[?#].*", "", u.strip().lower().replace("\\", "/")).split("://", 1)[-1].partition("/")
        hit = []
        for k, by in days.items():
            inside = (urls[u] + path[1] + path[2]).startswith(k) if k.endswith("/") else urls[u] == k or urls[u].endswith("." + k)
            held = [by[x] for x in sorted(by) if x <= d]
            if inside and held and None not in held[-1]:
                hit.append((len(k), k, max(held[-1])))
        return max(hit)[:0:-1] if hit else (None, None)

    got = {r.id: (r.verdict, r.matched_key) for r in url_filter.verdicts(captures, entries).collect()}
    assert got == {i: expected(u, d) for i, (u, d) in enumerate(asked)} and len({v for v, _ in got.values()}) == 4


def test_pipeline(spark, real):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, PATH).collect()
    kept = {r.doc_id for r in got}
    rows = {r.doc_id: r.text for r in real.collect()}
    assert len(kept) == len(got) and [r.start for r in sorted(got, key=lambda r: r.start)][0] == 0
    left, expected = real, None
    found = language.predict(real, language.learn(real.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))).collect()
    unspoken = {r.doc_id for r in found if r.lang_pred == "und" or r.score < corpus_pipeline.LEAST_SHARE}
    want = components_by_force([(i, t) for i, t in rows.items() if i not in unspoken])
    left = real.where(F.col("doc_id").isin([i for i, (_, c) in want.items() if i == c]))
    leaks = {r.doc_id for r in decontaminate.contaminated(left, spark.read.parquet(f"{PATH}/benchmark.parquet")).collect()}
    expected = {r.doc_id for r in left.collect()} - leaks
    assert kept == expected and leaks and len(unspoken) < 0.02 * len(rows)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents with null and repeated ids, nulls in all columns, equal rows, ties, a very long text and columns with the operators' own names; a benchmark."""
    import corpus_pipeline  # noqa: F401

    folder = str(tmp_path_factory.mktemp("odd"))
    items = spark.read.parquet(f"{PATH}/benchmark.parquet").where("text is not null").limit(2).collect()
    english = spark.read.parquet(f"{PATH}/documents.parquet").where("lang = 'en' and n_chars > 300").limit(60).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in english]
    leak = "some words before it " + items[0].text + " and some words after it"
    rows += [(None, leak, "en", "src0", 1), (rows[0][0], leak, None, None, None), (None, "12345 !!", None, "src1", 8), (None, None, None, None, None), (1 << 40, "", "en", "src1", 0)]
    rows += [(None, BASE + " alone", "en", None, 3)] * 2 + [(1 << 41, " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(80_000)), "en", "src2", 5)]
    extra = [(*r, 1.5, "x", -1) for r in rows]
    docs = spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, score double, _gone string, position long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items).write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs.schema


def test_stages_take_odd_rows(spark, odd):
    import corpus_pipeline

    folder, schema = odd
    docs = rows = spark.read.parquet(f"{folder}/documents.parquet")
    texts = lambda df: sorted((str(r.doc_id), str(r.text)) for r in df.collect())
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.columns == schema.names
        out.write.parquet(f"{folder}/{name}")
        before, docs = texts(docs), spark.read.parquet(f"{folder}/{name}")
        now = texts(docs)
        gone = [x for x in before if before.count(x) > now.count(x)]
        if name == "language":
            assert sorted({t for _, t in gone}) == ["", "12345 !!", "None"]
        elif name == "near_copies":
            assert [t for t in now if t[1] == BASE + " alone"] == [("None", BASE + " alone")]
        elif name == "test_items":
            assert len(gone) == 1 and all("some words before it" in t for _, t in gone)
        else:
            assert now == before
    got = corpus_pipeline.write_token_files(spark, docs, folder).orderBy("start").collect()
    assert len(got) == docs.count() and sum(r.n_tokens for r in got) == got[-1].start + got[-1].n_tokens
    empty = rows.limit(0)
    empty.write.parquet(f"{folder}/empty")
    empty = spark.read.parquet(f"{folder}/empty")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_token_files_of_the_pipeline_are_in_the_order_of_the_mixture(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, f"text number {i}", f"src{i * 3 // 1200}") for i in range(1200)] + [(-i - 1, f"without an id {i}", f"src{i % 3}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    corpus_pipeline.mix_sources(spark, docs, PATH).write.option("maxRecordsPerFile", 100).parquet(str(tmp_path / "mixed"))
    mixed = spark.read.parquet(str(tmp_path / "mixed"))
    assert mixed.columns == docs.columns
    source = {i: s for i, _, s in rows}
    files = [r.doc_id for r in corpus_pipeline.write_token_files(spark, mixed, PATH).orderBy("start").collect()]
    again = [r.doc_id for r in corpus_pipeline.write_token_files(spark, docs, PATH).orderBy("start").collect()]
    assert files == again and sorted(files) == sorted(source)
    weights = {"src0": Fraction(4), "src1": Fraction(2), "src2": Fraction(64, 64)}
    done = dict.fromkeys(weights, 0)
    for t, i in enumerate(files[:700], 1):  # src0 has 420 documents, so all go on until here
        done[source[i]] += 1
        if t % 16 == 0:
            assert all(abs(done[s] - w / 7 * t) < 16 for s, w in weights.items())


def test_every_operator_of_the_list_has_a_query():
    from tidemark.llm.queries import QUERIES

    assert {int(q[2:].split("_")[0]) for q in QUERIES} == set(range(1, 11))


def test_large_sides_are_not_broadcast(spark):
    from tidemark.llm.common import checked_broadcast

    told = lambda df: df._jdf.queryExecution().toString()
    assert "broadcast" in told(checked_broadcast(spark.range(3), 3)) and "broadcast" not in told(checked_broadcast(spark.range(4), 3))


def test_hot_join_keeps_all_rows(spark):
    from tidemark.llm.common import hot_join

    many = spark.range(5000).selectExpr("id", "case when id < 3000 then 0 else id % 1500 + 1 end as k")
    one = many.groupBy("k").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("first"))
    got = hot_join(many, one, "k", "rows").groupBy().agg(F.count(F.lit(1)), F.sum("first"), F.countDistinct("id")).first()
    want = many.join(one, "k").agg(F.count(F.lit(1)), F.sum("first"), F.countDistinct("id")).first()
    assert tuple(got) == tuple(want)
    assert hot_join(many.limit(0), one.limit(0), "k", "rows").count() == 0
