"""Column expressions over text: words, offsets, lines of stand-off files and answers."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

# Fixed value: a word is a dotted abbreviation, letters and digits with inner apostrophes or hyphens, or one other mark.
WORD = r"(?:[A-Za-z]\.){2,}|[\p{L}\p{N}_]+(?:['’-][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_\s\p{Z}\x{85}]"


def bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it, in lambdas too."""
    return F.get(F.transform(F.array(value), f), 0)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def gaps(text: Column) -> Column:
    """What stands before, between and after the words: one more than there are words."""
    return F.split(text, WORD, -1)


def begins_sentence(words: Column, gaps: Column):
    """For the number of a word: whether a sentence begins there, the first word, one after a run of end marks, or on a new line."""
    def begins(i):
        mark = lambda k: F.get(words, k).isin(".", "!", "?")
        return (i == 0) | F.contains(F.get(gaps, i), F.lit("\n")) | (mark(i - 1) & ~mark(i))

    return begins


def _placed(words: pa.Array, gaps: pa.Array) -> pa.Array:
    """Words of a batch with their places, from the lengths of the words and of the gaps between them."""
    n_words, n_gaps = (pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (words, gaps))
    word_len, gap_len = (pc.utf8_length(pc.list_flatten(x)).to_numpy(zero_copy_only=False).astype(np.int64) for x in (words, gaps))
    upto_word, upto_gap = np.r_[0, np.cumsum(word_len)], np.r_[0, np.cumsum(gap_len)]
    first_word, first_gap = np.cumsum(n_words) - n_words, np.cumsum(n_gaps) - n_gaps
    row, at = np.repeat(np.arange(len(n_words)), n_words), np.arange(n_words.sum())
    before = at - first_word[row] + first_gap[row] + 1  # gaps up to and including the one before the word
    start = upto_gap[before] - upto_gap[first_gap[row]] + upto_word[at] - upto_word[first_word[row]]
    values = pa.StructArray.from_arrays([pc.list_flatten(words), pa.array(start.astype(np.int32)), pa.array((start + word_len).astype(np.int32))], ["word", "start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n_words)].astype(np.int32)), values)


def word_spans(text: Column) -> Column:
    """Words with their character offsets ``(word, start, end)``. Null texts have none."""
    item = T.StructType([T.StructField("word", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    return F.arrow_udf(_placed, T.ArrayType(item))(words(text), gaps(text))


def char_offset(text: Column, n_bytes: Column) -> Column:
    """Characters in the first ``n_bytes`` bytes of the text's UTF-8 form."""
    return F.length(F.decode(F.substring(F.encode(text, "utf-8"), F.lit(1), n_bytes.cast("int")), "utf-8"))


def annotation_line(line: Column) -> Column:
    """``(id, type, start, end, surface)`` of a span line of a stand-off file; null for other lines."""
    fields = F.split(line, "\t")
    info = F.split(F.get(fields, 1), " ")
    return F.when(line.rlike("^T"), F.struct(
        F.get(fields, 0).alias("id"), F.get(info, 0).alias("type"), F.get(info, 1).try_cast("int").alias("start"),
        F.get(info, 2).try_cast("int").alias("end"), F.get(fields, 2).alias("surface")))


def padded_plain(text: Column) -> Column:
    """Lower case, runs of other than ASCII letters and digits as one blank, a blank at either end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), F.lit(" "))


def surface(tokens: Column, first: Column, last: Column) -> Column:
    return F.lower(F.array_join(F.slice(tokens, first + 1, last - first + 1), " "))


def numbered_lines(sentences: Column) -> Column:
    """One line for each token list: its number, a colon and the tokens."""
    return F.array_join(F.transform(sentences, lambda s, i: numbered_line(i, s)), "\n")


def numbered_line(no: Column, tokens: Column) -> Column:
    return F.concat(no.cast("string"), F.lit(": "), F.array_join(tokens, " "))


def token_char_spans(tokens: Column) -> Column:
    """``(start, end)`` of each token in the text of all tokens joined by blanks; a null token is empty."""
    def run(tokens: pa.Array) -> pa.Array:
        rows = pc.list_parent_indices(tokens).to_numpy(zero_copy_only=False)
        n = pc.fill_null(pc.utf8_length(pc.list_flatten(tokens)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.searchsorted(rows, np.arange(len(tokens) + 1))
        ends = np.cumsum(n + 1) - 1
        base = np.concatenate(([0], ends + 1))[first[rows]] if len(rows) else ends
        values = pa.StructArray.from_arrays([pa.array((ends - n - base).astype(np.int32)), pa.array((ends - base).astype(np.int32))], ["start", "end"])
        return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), values)

    item = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    return F.arrow_udf(run, T.ArrayType(item))(tokens)


def _inlined(tokens: pa.Array, types: pa.Array, firsts: pa.Array, lasts: pa.Array) -> pa.Array:
    """Texts of a batch: tokens and tags are pieces, put in order by row, token, and the tags' numbers."""
    rows = pc.list_parent_indices(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
    n = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    place = np.arange(len(rows)) - (np.cumsum(n) - n)[rows]
    words = pc.fill_null(pc.list_flatten(tokens), "")
    of = pc.list_parent_indices(types).to_numpy(zero_copy_only=False).astype(np.int64)
    counts = pc.fill_null(pc.list_value_length(types), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    number = np.arange(len(of)) - (np.cumsum(counts) - counts)[of]
    name, first, last = (pc.list_flatten(x) for x in (types, firsts, lasts))
    there = np.flatnonzero(pc.is_valid(first).to_numpy(zero_copy_only=False))
    take = pa.array(there)
    name, of, number = pc.fill_null(name.take(take), ""), of[there], number[there]
    first, last = (x.take(take).to_numpy(zero_copy_only=False).astype(np.int64) for x in (first, last))
    opens = pc.binary_join_element_wise("<", name, " id=", pa.array(number).cast(pa.string()), ">", "")
    closes = pc.binary_join_element_wise("</", name, ">", "")
    m = len(of)
    order = np.lexsort((np.r_[np.zeros(len(rows)), number, -number], np.r_[np.ones(len(rows)), np.zeros(m), np.full(m, 2)], np.r_[place, first, last], np.r_[rows, of, of]))
    pieces = pa.concat_arrays([words, opens, closes]).take(pa.array(order))
    total = n + 2 * np.bincount(of, minlength=len(n))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(total)].astype(np.int32)), pieces), " ")


def only_types(mentions: Column, types: list[str]) -> Column:
    """Mentions of some types, however these are written."""
    return F.filter(mentions, lambda m: F.lower(F.trim(m["type"])).isin([t.strip().lower() for t in types]))


def inline_tags(tokens: Column, mentions: Column) -> Column:
    """Tokens joined by blanks, each mention ``(type, tokens)`` in a tag with its number, at its first and last token.

    Null tokens are empty; positions that no token has are left out, as is a mention without any; null arrays are empty.
    """
    own = F.coalesce(tokens, F.array().cast("array<string>"))
    inside = lambda m: F.filter(m["tokens"], lambda i: (i >= 0) & (i < F.size(own)))
    name = F.transform(mentions, lambda m: F.replace(F.lower(m["type"]), F.lit(" "), F.lit("_")))
    first, last = (F.transform(mentions, lambda m: f(inside(m)).cast("int")) for f in (F.array_min, F.array_max))
    return F.arrow_udf(_inlined, T.StringType())(own, name, first, last)


def html(text: Column) -> Column:
    """Marks of markup escaped."""
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


#: Marks that LaTeX reads as commands, and how they are written.
LATEX = {"&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}", "\\": r"\textbackslash{}"}


def latex(text: Column) -> Column:
    """Marks of LaTeX escaped, each once: a text's characters are gone through, not the text again and again."""
    names = F.create_map(*(F.lit(x) for kv in LATEX.items() for x in kv))
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(names, c), c)), "")


def between(text: Column, prefix: str, marker: str) -> Column:
    """What stands before the first ``marker``, without the prefix."""
    return F.regexp_replace(F.substring_index(text, marker, 1), "^" + re.escape(prefix), "")


def answer_line(line: Column, n_sentences: Column) -> Column:
    """A line of a model's answer: text, type and sentence number in three or four fields split by tabs.

    ``issue`` is 'ignored_line' for a line without fields, 'dropped_malformed' for too few or many fields or a
    number out of range, else null.
    """
    fields = F.filter(F.transform(F.split(line, "\t"), lambda x: F.trim(x)), lambda x: x != "")
    number = F.get(fields, 2).try_cast("int")
    good = F.size(fields).between(3, 4) & number.isNotNull() & (number >= 0) & (number < n_sentences)
    issue = F.when(F.size(fields) < 2, "ignored_line").when(~F.coalesce(good, F.lit(False)), "dropped_malformed")
    keep = issue.isNull()
    return F.struct(F.when(keep, F.get(fields, 0)).alias("text"), F.when(keep, F.lower(F.get(fields, 1))).alias("type"), F.when(keep, number).alias("sentence"), issue.alias("issue"))


def cluster_lines(answer: Column, n_mentions: Column) -> Column:
    """Clusters of an answer with the numbers of mentions on each line, and one for each mention left out.

    Fields that aren't numbers of mentions are ignored; a line that names one mention only gives an empty cluster.
    """
    lines = F.transform(F.split(answer, "\n"), lambda line: F.filter(
        F.transform(F.split(F.trim(line), " +"), lambda x: x.try_cast("int")), lambda i: i.isNotNull() & (i < n_mentions)))
    used = F.filter(lines, lambda c: F.size(c) > 0)
    named = F.transform(used, lambda c: F.when(F.size(c) > 1, c).otherwise(F.array().cast("array<int>")))
    left = F.array_except(F.when(n_mentions > 0, F.sequence(F.lit(0), F.greatest(n_mentions - 1, F.lit(0)))).otherwise(F.array().cast("array<int>")), F.flatten(named))
    return F.concat(named, F.transform(left, lambda i: F.array(i)))
