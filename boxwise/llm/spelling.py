"""Groups of spelling variants: words one edit apart, by an even-partition pigeonhole join.

Every word of length l is cut in two even segments. Of two words of length l, or of l
and l + 1, that are one edit apart, the edit lies in one segment, and the other is found
in the longer word at its own place or one further on. The same holds once more
within the edited segment, whose halves are even too. So a word is indexed by its
length, one segment and a half of the other, and the words of the same length, or one
longer, look up the substrings at the places where these must stand. Segments of common
words are held by thousands, but their keys, which leave out a quarter of the word
only, by few, so that no group of candidates grows with the vocabulary's square.
Candidates from several keys are taken once and then compared.

Texts are read once; a task counts the words of many texts before they are shuffled, so
a frequent word costs a row a task.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwise.llm.common import STEP_BYTES, checkpointed, text_table

#: Fixed values of the contract: letters, least length and count of a word, how much more frequent a form must be, and what share of words is damaged.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, TIMES, DAMAGED = 6, 5, 5, 199
#: Different words that a task counts before it passes them on.
HELD = 200_000


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, damaged: int | None = DAMAGED) -> DataFrame:
    """(word, n) of the words of at least least_length code points that occur least_count times in the whole texts.

    Words are maximal runs of LETTERS with A-Z lowered. damaged: of the words whose
    crc32 of `<doc_id>:<word>` it divides, one code point is deleted first; null for none.
    """
    run = re.compile(f"[{LETTERS}]{{{least_length},}}")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def passed_on() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])
            found.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                text = text.as_py().encode().lower().decode()
                own = Counter(run.findall(text) if len(text) <= STEP_BYTES else (m[0] for m in run.finditer(text)))
                if damaged:
                    before = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for word in [w for w in own if zlib.crc32(w.encode(), before) % damaged == 0]:
                        at = zlib.crc32(word.encode(), before) % len(word)
                        n = own.pop(word)
                        if len(word) > least_length:
                            found[word[:at] + word[at + 1 :]] += n
                found.update(own)
                if len(found) >= HELD:
                    yield passed_on()
        yield passed_on()

    return text_table(docs).mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def keys(word: Column, length: Column) -> Column:
    """The keys of a word in the index of words of `length`, which is its own length or one less: a segment at its place, and a half of the rest at one end of it."""
    first = F.floor(length / 2).cast("int")
    second = length - first
    a, b = F.floor(first / 2).cast("int"), F.floor(second / 2).cast("int")
    start = lambda n: F.substr(word, F.lit(1), n)
    end = lambda n: F.right(word, n)
    # The edit in the last, third, second or first quarter.
    return F.array(start(first + b), F.concat(start(first), end(second - b)), F.concat(start(a), end(second)), end(length - a))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b) of the words (word, n) that are one inserted, deleted or replaced code point apart, each pair once."""
    sized = words.select("word", "n", F.char_length("word").alias("length"))

    def side(length: Column, end: str) -> DataFrame:
        return sized.select(F.col("word").alias(end), F.col("n").alias(f"n_{end}"), length.alias("length"), F.posexplode(keys(F.col("word"), length)).alias("quarter", "key"))

    index = side(F.col("length"), "a")
    probes = side(F.col("length"), "b").unionByName(side(F.col("length") - 1, "b"))
    same = F.char_length("a") == F.char_length("b")
    close = (~same | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
    return index.join(probes, ["length", "quarter", "key"]).where(close).select("a", "n_a", "b", "n_b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the rows (word, form): what following forms ends at. Each round doubles the steps; a chain is short, as every form is several times as frequent."""
    hops = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        next_ = hops.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if hops.join(next_, "root", "left_semi").isEmpty():
            return hops
        hops = checkpointed(hops.join(next_, "root", "left").select("word", F.coalesce("further", "root").alias("root")))


def spelling_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES, damaged: int | None = DAMAGED) -> DataFrame:
    """One row a word: word, form, root (string), n, n_near, form_n (long).

    n_near: the words one edit apart. form: of those the most frequent, the first in
    code-point order of equal ones, if it is `times` as frequent as the word, else null,
    with form_n its count. root: where following forms ends, the word itself without a
    form. Null and empty texts have no words; a null doc_id counts as an empty one in
    the checksum; rows that repeat are counted each; a run of any length is one word. An
    empty table gives no rows. Columns other than doc_id and text are not read.
    """
    words = checkpointed(word_counts(docs, least_length, least_count, damaged))
    pairs = near_pairs(words)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("form"))).alias("best"))
    is_form = -F.col("best.less") >= F.lit(times) * F.col("n")
    named = words.join(best, "word", "left").select("word", F.when(is_form, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, -F.col("best.less")).alias("form_n"))
    named = checkpointed(named)
    return named.join(roots(named.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def crc32_sql(text: str) -> str:
    """DuckDB SQL of the unsigned crc32 of a text's UTF-8 bytes, by a table of the remainders of all bytes."""
    table = []
    for r in range(256):
        for _ in range(8):
            r = r >> 1 ^ (0xEDB88320 if r & 1 else 0)
        table.append(r)
    step = f"xor(c >> 8, {table}[(xor(c, b) & 255) + 1])"
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {step}))"


def oracle_sql() -> str:
    """DuckDB SQL of spelling_variants over documents: pairs by deletion, words that are equal without one code point."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
        WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents),
        own AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL),
        hashed AS (SELECT *, {crc32_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM own),
        damaged AS (SELECT CASE WHEN h % {DAMAGED} = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
        words AS (SELECT word, sum(n)::BIGINT AS n FROM damaged WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
        less AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1))::INT AS i FROM words)),
        near AS (
            SELECT a.word, a.n, b.word AS other, b.n AS m FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
            UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
        best AS (SELECT word, count(*) AS n_near, min({{'less': -m, 'form': other}}) AS best FROM near GROUP BY word),
        named AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= {TIMES} * n THEN best.form END AS form, CASE WHEN -best.less >= {TIMES} * n THEN -best.less END AS form_n FROM words LEFT JOIN best USING (word)),
        steps AS (SELECT word, word AS root, 0 AS k FROM named UNION ALL SELECT s.word, f.form, k + 1 FROM steps s JOIN named f ON s.root = f.word WHERE f.form IS NOT NULL),
        ends AS (SELECT word, arg_max(root, k) AS root FROM steps GROUP BY word)
        SELECT word, form, root, n, n_near, form_n FROM named JOIN ends USING (word)"""
