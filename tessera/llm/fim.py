"""Fill-in-the-middle texts: units cut by lookaround, two cuts drawn from a hash, pieces put in order behind sentinels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import unused

SENTINELS = ("<P>", "<S>", "<M>")
WHITE = r"\x20\x09-\x0D"
#: A unit grammar as the borders between two units: the class of the character before and that of the one after it. A
#: class is what stands between the brackets of a character class; an empty one is any character.
GRAMMARS: dict[str, tuple[tuple[str, str], ...]] = {
    "token": ((f"^{WHITE}", WHITE),),  # white space leads the word after it, as in [\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+
    "word": ((f"^{WHITE}", WHITE), (WHITE, f"^{WHITE}")),  # words and the white space between them
    "line": ((r"\n", ""),),  # a line with its end
    "sentence": ((r".!?\n", WHITE),),  # a sentence ends before the white space after . ! or ?
    "letters": (("0-9A-Za-z", "^0-9A-Za-z"), ("^0-9A-Za-z", "0-9A-Za-z")),  # runs of ASCII letters and digits, and the rest
    "character": (("", ""),),
}


def boundary(grammar: tuple[tuple[str, str], ...]) -> str:
    """The regular expression of width zero that matches exactly where a unit ends and another begins."""
    side = lambda c: f"[{c}]" if c else r"[\x{0}-\x{10FFFF}]"
    return "|".join(f"(?={side(after)})(?<={side(before)})" for before, after in grammar)


def units(text: Column, grammar: str = "token") -> Column:
    """The units of a text in order, which joined are the text again; null and empty texts have none."""
    some = F.coalesce(text, F.lit("")) != ""
    return F.when(some, F.split(text, boundary(GRAMMARS[grammar]), -1)).otherwise(F.array().cast("array<string>"))


def _drawn(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32 that depend on the id alone; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text that an output of transform() was made from."""
    part = F.split(output, "|".join(SENTINELS), -1)
    spm = F.concat(part[2], part[3], part[1])
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(spm)


def transform(docs: DataFrame, carried: list[str] | None = None, grammar: str = "token", rate: int = 50, spm_share: int = 80, seed: int = 42) -> DataFrame:
    """The carried columns of docs (doc_id, unless told) with n, form, prefix, middle, suffix and output.

    n is the number of units; of rate in 100 documents the prefix ends after one unit that is drawn and the middle after
    another. spm_share in 100 of these are spm (`<S>`suffix`<P>`prefix`<M>`middle), the others psm
    (`<P>`prefix`<S>`suffix`<M>`middle). Texts that are empty or hold a sentinel, and the rest, are plain: the text itself,
    with null for the three pieces. Null texts count as empty and a null id as an empty one; equal rows come out equal, as
    nothing but id and text decides; an empty table gives an empty one, and other columns of docs, whatever their names,
    have no part. Texts are taken whole: a row is the largest thing that is held. No row is exchanged.
    """
    carried = carried or ["doc_id"]
    if clash := {"n", "form", "prefix", "middle", "suffix", "output"} & {c.lower() for c in carried}:
        raise ValueError(f"columns {sorted(clash)} have the names of results")
    text, made, cut = unused(carried, "text", "made", "cut")
    source = docs.select(*carried, F.coalesce(docs["text"], F.lit("")).alias(text), F.array(*_drawn(docs["doc_id"], seed)).alias(cut))
    split = source.withColumn(made, units(F.col(text), grammar))
    n = F.size(made).cast("long")
    ends = [F.col(cut)[k] % (n + 1) for k in range(2)]
    held = F.rlike(text, F.lit("|".join(SENTINELS)))
    form = F.when((n == 0) | held | (F.col(cut)[2] % 100 >= rate), "plain").when(F.col(cut)[3] % 100 < spm_share, "spm").otherwise("psm")
    low, high, n_, form_ = unused([*carried, text, made, cut], "low", "high", "n", "form")
    placed = split.select(*carried, text, made, n.alias(n_), form.alias(form_), F.least(*ends).cast("int").alias(low), F.greatest(*ends).cast("int").alias(high))
    piece = lambda a, b: F.when(F.col(form_) != "plain", F.array_join(F.slice(made, a + 1, b - a), ""))
    prefix, middle, suffix = piece(F.lit(0), F.col(low)), piece(F.col(low), F.col(high)), piece(F.col(high), F.size(made))
    cutted = placed.select(*carried, text, F.col(n_).alias("n"), F.col(form_).alias("form"), prefix.alias("prefix"), middle.alias("middle"), suffix.alias("suffix"))
    p, s, m = (F.lit(x) for x in SENTINELS)
    spm, psm = F.concat(s, "suffix", p, "prefix", m, "middle"), F.concat(p, "prefix", s, "suffix", m, "middle")
    output = F.when(F.col("form") == "plain", F.col(text)).when(F.col("form") == "psm", psm).otherwise(spm)
    return cutted.select(*carried, "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def digest(docs: DataFrame) -> DataFrame:
    """transform() with lengths and SHA-256 in place of texts, and that of the text rebuilt from output and form."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    made = transform(docs).select("doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), "output")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


#: The same with the grammar matched as it is written, not by its borders.
ORACLE = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (SELECT *, len(u) AS n, [CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) FOR k IN [0, 1, 2, 3]] AS d FROM cut),
formed AS (
  SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 50 THEN 'plain'
         WHEN d[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
pieces AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256
FROM pieces
"""
