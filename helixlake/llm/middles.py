"""Fill-in-the-middle: whole texts cut at unit ends and rearranged around sentinels, and put together again."""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from helixlake.plans.staging import ship

#: A unit is a line with its end.
LINE = r"[^\n]*\n|[^\n]+"
#: Sentinels before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
FORMS = ("plain", "psm", "spm")


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """Refuse sentinels whose places in an output could be mistaken: a sentinel's first letter must be in none after its
    first place, so that none arises where a text meets a sentinel, and none may start another."""
    heads = {s[:1] for s in sentinels}
    if len(set(sentinels)) != 3 or not all(sentinels) or any(c in heads for s in sentinels for c in s[1:]):
        raise ValueError("three different sentinels, each with first letters that none has further on")
    if any(a != b and b.startswith(a) for a in sentinels for b in sentinels):
        raise ValueError("no sentinel may start another")


def ends_of(text: str, unit: regex.Pattern) -> array:
    """Where each unit ends, in code points, four bytes each."""
    return array("I", (m.end() for m in unit.finditer(text)))


def draws(seed: int, doc_id: str) -> list[int]:
    """The first four 32-bit numbers of the SHA-256 of `seed:doc_id`."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def rearrange(text: str, doc_id: str, unit: regex.Pattern, seed: int, percent: int, spm_percent: int, sentinels: tuple[str, str, str]) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, length of the prefix, of the middle, output) of one text."""
    ends = ends_of(text, unit)
    n = len(ends)
    one, two, apply, kind = draws(seed, doc_id)
    if not text or apply % 100 >= percent or any(s in text for s in sentinels):
        return n, "plain", None, None, text
    low, high = sorted((one % (n + 1), two % (n + 1)))
    a, b = (ends[i - 1] if i else 0 for i in (low, high))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = sentinels
    if kind % 100 < spm_percent:
        return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def rebuild(output: str, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> str:
    """The text of which an output of this form was made."""
    if form == "plain":
        return output
    p, s, m = sentinels
    first, second = (p, s) if form == "psm" else (s, p)
    if not output.startswith(first):
        raise ValueError(f"an output of form {form} starts with {first}")
    one, found, rest = output[len(first) :].partition(second)
    two, last, middle = rest.partition(m)
    if not found or not last:
        raise ValueError(f"an output of form {form} holds {second} and {m}")
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fill_in_middle(docs: DataFrame, unit: str = LINE, seed: int = 7, percent: int = 100, spm_percent: int = 50, sentinels: tuple[str, str, str] = SENTINELS, outputs: bool = True, digests: bool = False) -> DataFrame:
    """Rearrange docs.text around a middle of whole units.

    `unit` is matched left to right over code points. Four numbers hashed from seed and doc_id decide: the first two, modulo
    units + 1, where prefix and middle end; the third, modulo 100, whether the text is rearranged (below `percent`); the
    fourth the form, spm (suffix first) below `spm_percent`, else psm. Texts that are empty or hold a sentinel stay plain.

    Result: docs' columns without text, then n long (units), form, prefix_chars, middle_chars long (code points, null if
    plain); output with outputs; with digests output_sha256 and restored_sha256, the latter of the text rebuilt from
    output and form alone. A null text is empty and a null doc_id hashes as no digits. Repeated rows are treated each, docs'
    columns of these names are replaced, an empty table gives an empty result. Texts are whole, in Arrow batches.
    """
    check_sentinels(sentinels)
    ship(docs.sparkSession)
    fields = "n long, form string, prefix_chars long, middle_chars long" + ", output string" * outputs + ", output_sha256 string, restored_sha256 string" * digests

    @pandas_udf(fields)
    def cut(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        pattern = regex.compile(unit)
        rows = []
        for doc_id, text in zip(ids, texts, strict=True):
            *head, output = rearrange(text, doc_id, pattern, seed, percent, spm_percent, sentinels)
            rows.append((*head, *[output] * outputs, *((_sha(output), _sha(rebuild(output, head[1], sentinels))) if digests else ())))
        names = [f.split()[0] for f in fields.split(", ")]
        out = pd.DataFrame(rows, columns=names)
        return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    made = [f.split()[0] for f in fields.split(", ")]
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("text", *made)]
    digits = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    # an expression of its own, so that the UDF runs once a row whatever is selected of it
    done = docs.select(F.struct(*kept).alias("_row"), cut(digits, F.coalesce(F.col("text"), F.lit(""))).alias("_cut"))
    names = [c for c in docs.columns if c.lower() not in ("text", *made)]
    return done.select(*[F.col(f"_row.`{c}`").alias(c) for c in names], *[F.col(f"_cut.{c}").alias(c) for c in made])


def restore(outputs: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Add `restored`: the texts rebuilt from the columns output and form. A null output gives null."""
    check_sentinels(sentinels)
    ship(outputs.sparkSession)

    @pandas_udf("string")
    def back(output: pd.Series, form: pd.Series) -> pd.Series:
        return pd.Series([None if o is None else rebuild(o, f, sentinels) for o, f in zip(output, form, strict=True)], dtype=object)

    return outputs.withColumn("restored", back("output", "form"))
