"""Text of slices on the way to samples: tokens, canonical names, hashes, padding, vocabularies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Operators of two and three characters, longest first.
OPERATORS = ["<<=", ">>=", "...", "->", "++", "--", "<<", ">>", "<=", ">=", "==", "!=", "&&", "||", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "::"]
# Words that canonical names leave alone.
KEYWORDS = [
    "auto", "bool", "break", "case", "catch", "char", "class", "const", "continue", "default", "delete", "do", "double", "else", "enum", "extern", "false", "float", "for", "goto", "if",
    "inline", "int", "long", "namespace", "new", "NULL", "private", "protected", "public", "register", "return", "short", "signed", "sizeof", "static", "struct", "switch", "template",
    "this", "throw", "true", "try", "typedef", "union", "unsigned", "using", "virtual", "void", "volatile", "wchar_t", "while", "size_t", "main", "stdin", "stdout", "stderr",
]

#: Loops are possessive, so that literals of any length are matched without recursion.
TOKEN = (
    r"\"[^\"\\]*+(?:\\[^\n][^\"\\]*+)*+\"|'[^'\\]*+(?:\\[^\n][^'\\]*+)*+'|[A-Za-z_][A-Za-z0-9_]*|[0-9][A-Za-z0-9_.]*|"
    + "|".join("".join("\\" + c for c in x) for x in OPERATORS)
    + r"|[^\sA-Za-z0-9_]"
)


def c_tokens(code: Column) -> Column:
    """The tokens of a line of C: literals, names, numbers, operators of up to three characters. The last name of a text counts like any other."""
    return F.regexp_extract_all(code, F.lit(TOKEN), F.lit(0))


def is_name(token: Column) -> Column:
    return token.rlike("^[A-Za-z_]") & ~token.isin(KEYWORDS)


def canonical(tokens: Column, keep: list[str] | None = None) -> Column:
    """Tokens with names replaced by ``func_k`` before a bracket, else by ``variable_k``, numbered as they first appear; ``keep`` names stay."""
    stays = frozenset([*KEYWORDS, *(keep or [])])

    # Numbering by first place is linear in Python and quadratic in expressions, which counts for statements of many thousand tokens.
    def one(ts) -> list[str] | None:
        if ts is None:
            return None
        ts = list(ts)
        free = [t is not None and t[:1].isascii() and (t[:1].isalpha() or t[:1] == "_") and t not in stays for t in ts]
        calls = dict.fromkeys(t for t, f, after in zip(ts, free, [*ts[1:], ""]) if f and after == "(")
        others = dict.fromkeys(t for t, f in zip(ts, free) if f and t not in calls)
        names = {t: f"func_{k}" for k, t in enumerate(calls)} | {t: f"variable_{k}" for k, t in enumerate(others)}
        return [names[t] if f else t for t, f in zip(ts, free)]

    def named(column):
        return column.map(one)

    named.__annotations__ = {"column": pd.Series, "return": pd.Series}
    return F.pandas_udf(named, "array<string>")(tokens)


def is_number(token: Column) -> Column:
    """Whether a token reads as a number; a null doesn't."""
    return token.isNotNull() & token.try_cast("double").isNotNull()


def slice_hash(lines: Column) -> Column:
    """The digest of a slice: its lines without their numbers, joined by blanks; lines without a number don't count."""
    numbered = F.filter(lines, lambda x: x.rlike(r" [0-9]+$"))
    return F.md5(F.array_join(F.transform(numbered, lambda x: F.regexp_replace(x, r" [0-9]+$", "")), " "))


def without_output(code: Column) -> Column:
    """A line without comments and without the text of calls that print."""
    bare = F.regexp_replace(code, r"/\*.*?\*/|//.*$", "")
    return F.regexp_replace(bare, r"\b(printf|fprintf|printLine) \(.*$", "$1 ( )")


def pad(tokens: Column, size: int, focus: Column | None = None, filler: str = "") -> Column:
    """Tokens cut or filled to ``size``: filled at the end; cut to a window around ``focus`` (from 1), which stays within the list."""
    at = F.coalesce(focus if focus is not None else F.lit(1), F.lit(1))
    start = F.greatest(F.lit(1), F.least(at - size // 2, F.size(tokens) - size + 1))
    return F.when(F.size(tokens) >= size, F.slice(tokens, start, size)).otherwise(F.concat(tokens, F.array_repeat(F.lit(filler), F.greatest(F.lit(0), size - F.size(tokens)))))


def pad_ids(ids: Column, size: int, before: bool = True, cut_before: bool = True, filler: int = 0) -> Column:
    """Ids filled with ``filler`` and cut to ``size``, at the front unless told otherwise."""
    n = F.size(ids)
    short = F.array_repeat(F.lit(filler).cast("long"), F.greatest(F.lit(0), size - n))
    filled = F.concat(short, ids) if before else F.concat(ids, short)
    part = F.slice(ids, n - size + 1, size) if cut_before else F.slice(ids, 1, size)
    return F.when(n > size, part).otherwise(filled)


def text_words(text: Column) -> Column:
    """Words in lower case, cut at blanks and ASCII punctuation; ``'`` stays."""
    return F.filter(F.split(F.lower(text), r"[\s!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]+"), lambda w: w != "")


def hashed_ids(words: Column, size: int) -> Column:
    """Each word's id from its digest: from 1 to ``size - 1``."""
    return F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 15), 16, 10).cast("long"), F.lit(size - 1)) + 1)


def vocabulary(docs: DataFrame) -> DataFrame:
    """``(word, n, n_docs)`` of ``docs(doc_id, words)``."""
    each = docs.select("doc_id", F.explode("words").alias("word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("k"))
    return each.groupBy("word").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("n_docs"))


def tfidf(docs: DataFrame) -> DataFrame:
    """``(doc_id, word, weight)``: ``1 + ln(count)`` times ``ln(1 + documents / (1 + documents with the word))``."""
    each = docs.select("doc_id", F.explode("words").alias("word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("k"))
    df = each.groupBy("word").agg(F.count(F.lit(1)).alias("n_docs"))
    total = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    return each.join(df, "word").select("doc_id", "word", F.round((1 + F.log("k")) * F.log(1 + total / (1 + F.col("n_docs"))), 9).alias("weight"))


def term_matrix(docs: DataFrame, mode: str) -> DataFrame:
    """``(doc_id, word, value)`` of ``docs(doc_id, words)``: ``count`` how often a word occurs, ``binary`` that it does, ``freq`` its share of the words."""
    each = docs.select("doc_id", F.size("words").alias("size"), F.explode("words").alias("word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("k"), F.max("size").alias("size"))
    value = {"count": F.col("k").cast("double"), "binary": F.lit(1.0), "freq": F.col("k") / F.col("size")}[mode]
    return each.select("doc_id", "word", value.alias("value"))


def sampling_rates(rank: Column, factor: float = 1e-5) -> Column:
    """How likely a word is kept, by its rank among all words by frequency, if these are as Zipf has them; ranks count from 0, as which 1 counts."""
    r = F.greatest(rank, F.lit(1)).cast("double")
    expected = factor * (r * (F.log(r) + 0.577) + 0.5 - 1 / (12 * r))
    return F.least(F.lit(1.0), F.sqrt(expected))


def skipgrams(docs: DataFrame, window: int) -> DataFrame:
    """``(doc_id, word, context)`` for each two words at most ``window`` places apart, either way."""
    ws, n = F.col("words"), F.size("words")
    ways = []
    for k in range(1, window + 1):
        size = F.greatest(n - k, F.lit(0))
        before, behind = F.slice(ws, 1, size), F.slice(ws, k + 1, size)
        ways += [F.arrays_zip(before.alias("word"), behind.alias("context")), F.arrays_zip(behind.alias("word"), before.alias("context"))]
    return docs.where(n > 1).select("doc_id", F.inline(F.concat(*ways)).alias("word", "context"))


def reverse_index(docs: DataFrame) -> DataFrame:
    """``(word, doc_id, places)``: where each word stands in each document, from 0."""
    each = docs.select("doc_id", F.posexplode("words").alias("place", "word"))
    return each.groupBy("word", "doc_id").agg(F.sort_array(F.collect_list("place")).alias("places"))


def later_copies(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows that aren't the first of their key, for deletion. The first of each key comes from partial minima, so that one key may hold any share."""
    first = rows.groupBy(key).agg(F.min(order).alias("_first"))
    return rows.join(first, key).where(F.col(order) != F.col("_first")).drop("_first")


def fold(rows: DataFrame, order: str, folds: int) -> DataFrame:
    """Rows with their fold, from 0: contiguous pieces of equal width in the given order, the last maybe narrower. Numbered by ranges, not in one task."""
    numbered = numbered_rows(rows, order)
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    return numbered.withColumn("fold", F.floor((F.col("no") - 1) / F.ceil(total / F.lit(folds))).cast("int"))


def numbered_rows(rows: DataFrame, order: str) -> DataFrame:
    """Rows with ``no`` from 1 in order of a unique column. Ranges are numbered each on its own and offset by the sizes of those before."""
    parts = rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id())
    from weftgraph.operators.windows import kept_once

    parts = kept_once(parts)
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return parts.withColumn("no", own).join(F.broadcast(offsets), "_part").withColumn("no", F.col("no") + F.col("_before")).drop("_part", "_before")


def chunks(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Rows with the number of their chunk of ``size`` rows, from 0."""
    return numbered_rows(rows, order).withColumn("chunk", F.floor((F.col("no") - 1) / size)).drop("no")


def whole_batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Rows without what is left over after the last full batch."""
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    return numbered_rows(rows, order).where(F.col("no") <= total - total % F.lit(size)).drop("no")
