"""Anagram variants, word runs and the secret scan against brute force, with nulls, empties, ties, repeats, long texts and clashing columns."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import anagram, jaccard_join, queries, secrets, word_runs

PATH = "/root/testdata/sf0.001"
UPPER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def rows(spark):
    return [tuple(r) for r in spark.read.parquet(f"{PATH}/documents.parquet").select("doc_id", "text").collect()]


def write(spark, rows, folder):
    """A documents table with these (doc_id, text) and columns of other tables' names."""
    df = spark.createDataFrame([(i, t, "x", 1.0, 2) for i, t in rows], "doc_id long, text string, word string, key double, rules int")
    df.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


# ---- op11


def variants_by_force(c, ratio=10):
    near, by = {w: set() for w in c}, defaultdict(set)
    for w in c:
        for i in range(len(w)):
            d = w[:i] + w[i + 1 :]
            by[i, d].add(w)
            if d in c:
                near[w].add(d)
                near[d].add(w)
    for g in by.values():
        for a in g:
            near[a] |= g - {a}
    best = {w: min(ws, key=lambda x: (-c[x], x)) for w, ws in near.items() if ws}
    form = {w: b for w, b in best.items() if c[b] >= ratio * c[w]}
    out = {}
    for w, n in c.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), c[form[w]] if w in form else None)
    return out


def op11_by_force(rows):
    c = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(UPPER)
            h = crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                c[w] += 1
    return variants_by_force({w: n for w, n in c.items() if n >= 2})


def told(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("group", [64, 0])
def test_op11_equals_brute_force(spark, rows, monkeypatch, tmp_path, group):
    monkeypatch.setattr(anagram, "GROUP", group)
    assert told(queries.op11_anagram_variants(spark, PATH)) == op11_by_force(rows)
    own = [(None, "Straßenbahn STRASSENBAHN straßenbahn"), (1, None), (1, ""), (2, "12 _ ×÷×÷×÷× aaaaaaa " * 3), (2, "Élémentaire élémentaire " * 30), (3, "elémentaire élémentaires " * 2), (4, ("x" * 400 + " " + "x" * 399 + " ") * 2)]
    own += [(5, f"ab{'c' * k}defghij " * 3 ** k) for k in range(7)]
    assert told(queries.op11_anagram_variants(spark, write(spark, own, tmp_path / "a"))) == op11_by_force(own)
    assert queries.op11_anagram_variants(spark, write(spark, [(1, None)], tmp_path / "b")).count() == 0


def test_orders_of_the_same_letters_are_not_paired(spark):
    """All words of eight letters a and b: whole keys and their neighbours have dozens of words; what joins make stays near the links."""
    words = {"".join(x): 1 + (i * 7919) % 1000 for i, x in enumerate(np.array(list("ab"))[(np.arange(1 << 9)[:, None] >> np.arange(9)) & 1])}
    words |= {w[:4] + w[5:]: 3 for w in list(words)[::3]} | {"": 1}
    df = spark.createDataFrame(list(words.items()) + [(None, 5)], "word string, n long")
    assert told(anagram.variants(df)) == variants_by_force(words)
    many = anagram.residues(df.where("word is not null")).groupBy("res").count().where(F.col("count") > anagram.GROUP).count()
    assert many > 5


def test_near_words_are_told_by_plain_functions(spark):
    """Also letters that share a value with others; and no function of Spark's goes letter by letter over the pairs of words."""
    draw, letters = random.Random(5), "ab" + chr(97 + 4096) + chr(98 + 4096) + "é"
    words = {"".join(draw.choice(letters) for _ in range(draw.randrange(1, 6))): 1 + i % 90 for i in range(600)} | {"": 7, "aab": 40, "aaab": 3, "baab": 2}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert told(anagram.variants(df)) == variants_by_force(words)
    pairs = anagram._by_key(anagram.durable(anagram.residues(df), "residues"))
    found = [frozenset((r.a_word, r.b_word)) for r in pairs.collect()]
    assert len(found) == len(set(found))
    assert "lambda" not in pairs._jdf.queryExecution().toString()


def test_values_tell_letters_apart():
    values = {c**anagram.POWER for c in [*range(97, 123), *range(192, 256)]}
    assert len(values) == 90 and max(values) < 1 << 40


# ---- op12


def runs_by_force(w, shortest=6, periods=4):
    n, out = len(w), set()
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(shortest, periods * q) and not any(w[i : i + size - p] == w[i + p : i + size] for p in range(1, q)):
                out.add((i, size, q))
            i = max(j, i + 1)
    return sorted(out)


def test_periodic_equals_brute_force():
    random.seed(5)
    for _ in range(600):
        texts = []
        for _ in range(random.randint(1, 5)):
            n, k = random.randint(0, 60), random.choice([1, 2, 2, 3, 5, 30])
            w = [random.randrange(k) for _ in range(n)]
            if n and random.random() < 0.5:
                a, p = random.randrange(n), 1 + random.randrange(max(1, n // 4))
                w = [w[i] if i < a else w[min(a + (i - a) % p, n - 1)] for i in range(n)]
            if random.random() < 0.3:
                w = w[:10] * random.randint(1, 7) + w[::-1] + w[:7] * random.randint(1, 6)
            texts.append(w)
        doc = np.repeat(np.arange(len(texts)), [len(w) for w in texts])
        text, runs = word_runs.periodic(doc, np.array([x for w in texts for x in w], np.int64), len(texts))
        for i, w in enumerate(texts):
            assert [tuple(r) for r in runs[text == i].tolist()] == runs_by_force(w)


def test_long_periodic_texts_take_linear_work():
    n = 60_000
    for word in (np.zeros(n, np.int64), np.arange(n) % (n // 9), np.append(np.arange(n // 2), np.arange(n // 2) % 7)):
        _, runs = word_runs.periodic(np.zeros(n, np.int64), word, 1)
        assert len(runs) == 1


def op12_by_force(i, t):
    w = (t or "").encode().split()
    n, h = len(w), 1 if i is None else crc32(str(i).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[x] if x < a else w[a + (x - a) % p] for x in range(n)]
    runs = runs_by_force(w)
    gone = {x for s, size, q in runs for x in range(s + q, s + size)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None,) * 3
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha256(lines.encode()).hexdigest(), sha256(kept).hexdigest())


def test_op12_equals_brute_force(spark, rows, tmp_path):
    small = [(i, t) for i, t in rows if len(t or "") < 20_000]
    own = [(None, "a b " * 9), (None, None), (3, ""), (4, " \n\t"), (5, "x"), (5, "x x x x x"), (5, "x x x x x x"), (6, "été été été été été été été été\x0bété"), (7, "A a A a A a A a b"), (8, "a a a a a a b a a a a a a b a a a a a a b a a a a a a b")]
    own += [(100 + i, " ".join(f"w{k % (3 + i)}" for k in range(50 + i))) for i in range(120)]
    for each, folder in ((small, "a"), (own, "b"), ([], "c")):
        got = sorted(map(tuple, queries.op12_word_runs(spark, write(spark, each, tmp_path / folder)).collect()), key=str)
        assert got == sorted(((i, *op12_by_force(i, t)) for i, t in each), key=str)


def test_word_runs_keeps_other_lengths(spark):
    df = spark.createDataFrame([(1, "p q p q p q z z z z z")], "doc_id int, text string")
    (r,) = word_runs.word_runs(df, 5, 3).collect()
    assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (11, [(0, 6, 2), (6, 5, 1)], "p q z")
    with pytest.raises(ValueError, match="shorter"):
        word_runs.word_runs(df, 2, 2)


# ---- op13

BY_FORCE = [
    ("assign", re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    *((r.kind, r.compiled(), lambda m: True) for r in secrets.MORE),
]


def op13_by_force(text):
    found = sorted((m.start(), i, m.end()) for i, (_, p, fits) in enumerate(BY_FORCE) for m in p.finditer(text or "") if fits(m))
    line = lambda fs: ",".join(f"{BY_FORCE[i][0]}:{a}:{b}" for a, i, b in fs)
    return (*(sum(i == k for _, i, _ in found) for k in range(3)), sha256(line([f for f in found if f[1] < 3]).encode()).hexdigest(), line(found))


SECRETS = [
    None, "", "token", "token = 'abcdef'", 'token="token" : abcdefgh', "é\U0001f600 PassWord:  \"a1b2c3d4\" paſſword: abcdefgh api-key=abcdefg API_KEY=abcdefg apikey : x.y.z_w",
    "AKIA" + "Q" * 16, "AKIA" + "Q" * 15, "xAKIAAKIA" + "Z9" * 8, "f" * 23, "f" * 24 + "g" + "0" * 30, "secret: token=abcdefgh", "token=abcde token=abcdef",
    "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "aB3" * 12, "AIza" + "x" * 35, "xoxb-1234567890", "sk_live_" + "a" * 16, "eyJhbGciOiJI.eyJzdWIiOiIx.abc", "see postgres://user:pass@host/db",
    "word " * 30_000 + "token = zzzzzzz", "tok" + "\x00" + "en=abcdefgh",
]


def test_op13_equals_brute_force(spark, rows, tmp_path, monkeypatch):
    each = [(i if i % 5 else None, t) for i, t in enumerate(SECRETS)] + [(3, SECRETS[3])] * 3
    for data, folder in ((rows, "a"), (each, "b"), ([], "c")):
        got = queries.op13_secret_scan(spark, write(spark, data, tmp_path / folder)).collect()
        assert sorted(map(tuple, got), key=str) == sorted(((i, *op13_by_force(t)) for i, t in data), key=str)
    # a sorted stretch and a segment may be small
    monkeypatch.setattr(secrets, "STRETCH", 7)
    monkeypatch.setattr(secrets, "SEGMENT_ROWS", 3)
    got = queries.op13_secret_scan(spark, str(tmp_path / "b")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, *op13_by_force(t)) for i, t in each), key=str)


def holds(query, text):
    low = bytes(b + 32 if 65 <= b < 91 else b for b in text.encode())
    grams = {low[i] << 16 | low[i + 1] << 8 | low[i + 2] for i in range(len(low) - 2)}
    if isinstance(query, int):
        return query in grams
    return query is None or (all if query[0] == "and" else any)(holds(q, text) for q in query[1:])


def test_matches_fulfil_their_query():
    samples = {
        r"(abc|def)gh": ["abcgh", "defgh"], r"a?bcd": ["bcd", "abcd"], r"(abcd)+x": ["abcdx", "abcdabcdx"], r"[ab][cd]ef": ["acef", "bdef"], r"ab{3}c": ["abbbc"], r"a{2,}bcd": ["aabcd", "aaaaabcd"],
        r"(ab|c.d)efg": ["abefg", "cxdefg"], r"(?i)straße": ["STRAßE"], r"x(foo(bar|baz)+)?y": ["xy", "xfoobary"], r"(?=abc)abcd": ["abcd"], r"\bkey\d+=": ["key12="], r"(a|bcd|)efgh": ["efgh", "aefgh", "bcdefgh"],
    }
    for pattern, texts in samples.items():
        query = secrets.query_of(secrets.Rule("x", pattern))
        for text in texts:
            assert secrets.Rule("x", pattern).compiled().search(text) and holds(query, f"- {text} -"), pattern
    for rule in secrets.BASE + secrets.MORE:
        for text in filter(None, SECRETS):
            assert not rule.compiled().search(text) or holds(secrets.query_of(rule), text)
    assert [r.kind for r in secrets.BASE + secrets.MORE if secrets.query_of(r) is None] == ["hex"]


def test_an_index_serves_other_rules_and_leaves_texts_out(spark):
    texts = [f"some words here {i}" for i in range(300)] + ["the needle is here", "a NEEDLE", "need le"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = secrets.build_index(docs)
    rule = secrets.Rule("needle", "needle", flags=re.IGNORECASE)
    assert secrets.candidates(index, [secrets.query_of(rule)]).count() == 2
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.scan(docs, [rule], index).where("size(spans) > 0").collect()}
    assert got == {300: [("needle", 4, 10)], 301: [("needle", 2, 8)]}
    assert secrets.scan(docs.limit(0), [rule]).count() == 0


# ---- what the operators share


def test_pieces_have_few_rows_and_bytes():
    from tidemark.llm import words
    from tidemark.llm.common import pieces, raw_bytes

    batch = pa.record_batch([pa.array(["one two three four five six", None, ""] * 40_000)], names=["text"])
    sizes = [p.num_rows for p in pieces(iter([batch]), "text", 1 << 30)]
    assert sizes == [65_536, 120_000 - 65_536]
    for piece in pieces(iter([batch]), "text", 1 << 30):
        doc, tokens = words.shingle_sets(*raw_bytes(piece.column("text")), 5)
        assert np.bincount(doc, minlength=piece.num_rows).tolist() == [2 if x.as_py() else 0 for x in piece.column("text")]


def test_counts_of_many_tasks_are_added_a_few_at_a_time(spark, monkeypatch):
    texts = ["a line that all of them have here " + " ".join(f"u{i}x{j}" for j in range(4)) for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(13)
    found = []
    for most in (64, 2):
        monkeypatch.setattr(jaccard_join, "FAN_IN", most)
        found.append([x.tolist() for x in jaccard_join.hot_cells(jaccard_join.sets_of(docs, 5), len(texts))])
    assert found[0] == found[1] and max(found[0][1]) >= 120
