"""Grouping spelling variants by anagram hashing; DataFrame functions only.

A word's key is the sum of its letters' values, each a power of the letter's code point, modulo a prime below 2**61: all anagrams have one key, and one letter
more, less or exchanged moves it by a value, or by a difference of two values, whatever the letter's place. Words whose keys differ so are found by an equi-join:
a word sends its key once and, for each different letter that it has, the key less that letter's value. ``key(a) - value(x) = key(b)`` is a removal from a (or an
addition to b), ``key(a) - value(x) = key(b) - value(y)`` an exchange of x for y. Then the order of letters is verified.

A key that more than GROUP rows share (all the orders of some letters may be words) isn't paired: its rows are dealt again by key, place of the letter and a hash
of the other letters in their order. Such a group has words that differ in one place only, so it has as many words as there are letters. Nothing is left out by
that, and the rows that a join makes are at most GROUP times the rows that go in, plus the links that there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checked_broadcast, durable

#: The modulus of keys and the power of a letter's code point.
MODULUS, POWER = (1 << 61) - 1, 5
#: Rows of one key that are paired before their letters' order is looked at.
GROUP = 64
#: Letters of the words: A-Z, a-z and U+00C0 to U+00FF.
RUN = "[A-Za-zÀ-ÿ]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def letter_value(letter: Column) -> Column:
    """A letter's part of the key, below 2**60. Code points from 4096 on share their values with others, which the order of letters tells apart."""
    code = F.ascii(letter).cast("long") % F.lit(4096)
    power = code
    for _ in range(POWER - 1):
        power = power * code
    return power


def _left(key: Column, letter: Column) -> Column:
    return (key - letter_value(letter) + F.lit(MODULUS)) % F.lit(MODULUS)


def residues(words: DataFrame) -> DataFrame:
    """(res, gone, word, size, n): a row for the whole word, gone being '', and one for each different letter, gone, without its value."""
    key = F.aggregate(F.split("word", ""), F.lit(0).cast("long"), lambda total, c: (total + letter_value(c)) % F.lit(MODULUS))
    gone = F.array_distinct(F.concat(F.array(F.lit("")), F.split("word", "")))
    rows = words.select("word", "n", key.alias("key"), F.length("word").alias("size"), F.explode(gone).alias("gone"))
    return rows.select(F.when(F.col("gone") == "", F.col("key")).otherwise(_left(F.col("key"), F.col("gone"))).alias("res"), "gone", "word", "size", "n")


def _ends(side: str) -> list[Column]:
    return [F.col(c).alias(f"{side}_{c}") for c in ("gone", "word", "size", "n")]


def _without(word: str, at: Column) -> Column:
    """The word less the letter at a place from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def _one_more(more: str, less: str, letter: str) -> Column:
    """Whether one word has a letter once more than another."""
    times = lambda word: F.length(word) - F.length(F.replace(F.col(word), F.col(letter), F.lit("")))
    return times(more) == times(less) + 1


def _by_key(rows: DataFrame) -> DataFrame:
    """Pairs among rows of few rows a key: a and b's letters are the same up to some place and after it, where b has one more letter, or another. What is near at all
    is told first; then that it is by the letters of this row, which one word has once more, so that a pair comes once even where two differences of values are equal."""
    whole, less, pair = rows.where("gone = ''"), rows.where("gone <> ''"), ["a_word", "a_n", "b_word", "b_n"]
    removed = whole.select("res", *_ends("a")).join(less.select("res", *_ends("b")), "res").where("b_size = a_size + 1")
    exchanged = less.select("res", *_ends("a")).join(less.select("res", *_ends("b")), "res").where("a_gone < b_gone and a_size = b_size")
    half = "left(a_word, a_size div 2) = left(b_word, a_size div 2) or right(a_word, a_size div 2) = right(b_word, a_size div 2)"  # one edit spares half of the word
    both = removed.unionByName(exchanged).where(f"({half}) and levenshtein(a_word, b_word, 1) = 1")
    return both.where(_one_more("b_word", "a_word", "b_gone")).where((F.col("a_gone") == "") | _one_more("a_word", "b_word", "a_gone")).select(*pair)


def _by_order(rows: DataFrame) -> DataFrame:
    """The same pairs among rows of keys that many rows share: by key, place and a hash of the other letters in order."""
    pair = ["a_word", "a_n", "b_word", "b_n"]
    places = F.filter(F.transform(F.split("word", ""), lambda x, i: F.when(x == F.col("gone"), i)), lambda i: i.isNotNull())
    less = rows.where("gone <> ''").withColumn("at", F.explode(places)).withColumn("order", F.xxhash64(_without("word", F.col("at"))))
    first = less.where((F.col("at") == 0) | (F.substring("word", F.col("at"), F.lit(1)) != F.col("gone")))  # of a run of one letter, any may go
    whole = rows.where("gone = ''").withColumn("order", F.xxhash64("word"))
    removed = whole.select("res", "order", *_ends("a")).join(first.select("res", "order", "at", *_ends("b")), ["res", "order"]).where(F.col("a_word") == _without("b_word", F.col("at")))
    one, two = (less.select("res", "order", "at", *_ends(s)) for s in "ab")
    exchanged = one.join(two, ["res", "order", "at"]).where((F.col("a_gone") < F.col("b_gone")) & (_without("a_word", F.col("at")) == _without("b_word", F.col("at"))))
    return removed.select(*pair).unionByName(exchanged.select(*pair))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a_word, a_n, b_word, b_n), once for each two words (word, n) of which one becomes the other by one code point inserted, deleted or replaced."""
    rows = durable(residues(words), "residues")
    many = rows.groupBy("res").count().where(F.col("count") > GROUP).select("res")
    many = checked_broadcast(durable(many, "many"))
    return _by_key(rows.join(many, "res", "left_anti")).unionByName(_by_order(rows.join(many, "res", "left_semi")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: forms are followed to the last by doubling, so the rounds are the logarithm of the longest chain."""
    now = durable(forms.select("word", F.col("form").alias("root")), "roots")
    moved = True
    while moved:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = durable(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = not now.where("moved").isEmpty()
        now = now.select("word", "root")
    return now


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of words (word, n; words differ). form: of the words that one letter makes of it, that of the largest n (ties:
    first in code-point order), if its n is at least ratio times the word's; root: the end of the chain of forms, the word itself if it has none.

    No words give no rows. A null word is dropped, the empty word has near words of one letter. Long words are compared letter by letter.
    """
    words = durable(words.select("word", F.col("n").cast("long").alias("n")).where("word is not null"), "words")
    pairs = durable(near_pairs(words), "pairs")
    turned = pairs.select(F.col("b_word").alias("a_word"), F.col("b_n").alias("a_n"), F.col("a_word").alias("b_word"), F.col("a_n").alias("b_n"))
    best = F.min(F.struct((-F.col("b_n")).alias("m"), F.col("b_word").alias("form")))
    near = pairs.unionByName(turned).groupBy(F.col("a_word").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    told = words.join(near, "word", "left").withColumn("has", F.coalesce(-F.col("best.m") >= F.lit(ratio) * F.col("n"), F.lit(False)))
    told = durable(told.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("has"), F.col("best.form")).alias("form"), F.when(F.col("has"), -F.col("best.m")).alias("form_n")), "forms")
    last = roots(told.where("form is not null").select("word", "form"))
    return told.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def runs_of(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, run) for each maximal run of RUN's letters with at least so many, A-Z lower-cased. A null text has none."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"{RUN}{{{least},}}"), F.lit(0))).alias("run"))
    return found.select("doc_id", lower(F.col("run")).alias("run"))


def counted(words: DataFrame, least_length: int, least_n: int) -> DataFrame:
    """(word, n) of words of so many letters that occur so often."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)
