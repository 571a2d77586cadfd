"""Fill-in-the-middle by lookaround splitting, in Spark functions only.

A unit grammar is a list of character classes, each of which stands alone or
runs (``+``). Cutting a text into its units is the same as splitting it at
every place but those whose two neighbours are of one class that runs: a
regular expression of look-arounds that matches no character, so that ``split``
keeps every piece.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, table

#: Runs of ASCII letters, and every other code point by itself.
LETTERS = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_UNIT = re.compile(r"(\[(?:\\.|[^\]\\])+\])(\+?)")


def boundary(grammar: str) -> str:
    """The zero-width Java pattern that holds between two units of ``grammar``, such as ``[A-Za-z]+|[^A-Za-z]``.

    The classes of a grammar have no code point in common and all code points
    together, so neighbours of one running class belong to one unit and all
    others are cut apart. It holds at neither end, nor within a code point that
    Java keeps as two.
    """
    units = grammar.split("|") if "\\|" not in grammar and "[|" not in grammar else re.findall(r"\[(?:\\.|[^\]\\])+\]\+?", grammar)
    found = [_UNIT.fullmatch(u) for u in units]
    if not units or not all(found):
        raise ValueError(f"not a list of classes: {grammar!r}")
    together = "".join(f"(?!(?<={m[1]})(?={m[1]}))" for m in found if m[2])
    return rf"(?<!\A)(?!\z)(?![\x{{DC00}}-\x{{DFFF}}]){together}"


def units(text: Column, grammar: str = LETTERS) -> Column:
    """The units of a text in order; joined, they are the text. Empty and null texts have none."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


@dataclass(frozen=True)
class Shares:
    """Of a hundred texts, how many are rearranged, and of these how many begin with the suffix."""

    rearranged: int = 90
    suffix_first: int = 20


def _draw(seed: Column, k: int) -> Column:
    return F.conv(F.substring(seed, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, grammar: str = LETTERS, shares: Shares | None = None) -> DataFrame:
    """doc_id, text, n, form, prefix, middle, suffix and output for every row of ``docs`` (doc_id, text; others are ignored).

    The two cuts and the form are drawn from the SHA-256 of ``1:`` and the
    doc_id, so reruns and repeated rows agree. A text that is empty or null, or
    has one of the sentinels in it, stays plain: its pieces are null and its output is
    the text (empty if null). A null doc_id draws as an empty one would.
    """
    shares = shares or Shares()
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256).alias("_seed"))
    rows = held(rows, "_u", units(F.col("text"), grammar)).withColumn("n", F.size("_u").cast("long"))
    one, two = (F.pmod(_draw(F.col("_seed"), k), F.col("n") + 1).cast("int") for k in (0, 1))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.col("text").contains(mark)
    plain = (F.col("text") == "") | marked | (_draw(F.col("_seed"), 2) % 100 >= shares.rearranged)
    form = F.when(plain, "plain").when(_draw(F.col("_seed"), 3) % 100 < shares.suffix_first, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "n", form.alias("form"), "_u", F.least(one, two).alias("_a"), F.greatest(one, two).alias("_b"))

    def piece(start: Column, length: Column) -> Column:
        return F.when(F.col("form") != "plain", F.array_join(F.slice("_u", start, length), ""))

    end = F.col("n").cast("int")
    cut = F.struct(
        piece(F.lit(1), F.col("_a")).alias("prefix"),
        piece(F.col("_a") + 1, F.col("_b") - F.col("_a")).alias("middle"),
        piece(F.col("_b") + 1, end - F.col("_b")).alias("suffix"),
    )
    rows = held(rows, "_cut", cut).select("doc_id", "text", "n", "form", "_cut.*")
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    return held(rows, "output", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made of."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    of = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    out = output
    for name, order in of.items():
        out = F.when(form == name, F.concat(*[part[i] for i in order])).otherwise(out)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s,
                  regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
h AS (SELECT *, len(u) AS n, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2,
             CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM t),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:n], ''), '') AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE text END) AS output_sha256,
       sha256(CASE WHEN form = 'plain' THEN text ELSE pre || mid || suf END) AS restored_sha256
FROM p
"""
