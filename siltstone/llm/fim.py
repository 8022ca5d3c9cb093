"""Fill-in-middle (12): texts cut at unit boundaries and set in another order behind sentinels.

A unit grammar is an alternation of character classes that part all characters, each with or without ``+``: ``[A-Za-z]+|[^A-Za-z]``
makes words of letters and leaves every other character alone. ``boundary`` translates it to a zero-width regex that
looks at the two neighbours of a place only: behind a class without ``+`` every place is a boundary, behind one with ``+``
those that another class follows. Spark's ``split`` at it keeps every piece, so the pieces joined are the text. Java's regexes
look at whole code points, so no pair of surrogates is cut. All is Column code; no row leaves its task.

Cuts and forms are drawn from the sha256 of a seed and the row's id, so reruns and lost tasks draw alike.

Defined results: a null text counts as empty; an empty text has no units (``split`` would give one empty piece) and stays plain; so
does a text that holds a sentinel; a null id draws as an empty one; rows that repeat give rows that repeat; other columns
stay, and new ones whose names are taken get a longer prefix; an empty table gives an empty one. Texts of any length are
cut whole.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import unused

GRAMMARS = {
    "letters": r"[A-Za-z]+|[^A-Za-z]",
    "words": r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+",
    "lines": r"[\n]|[^\n]+",
    "characters": r"[\s\S]",
}
SENTINELS = ("<P>", "<S>", "<M>")
_ALTERNATIVE = r"(\[(?:\\.|[^\]\\])+\])(\+?)"
_ANY = r"(?=[\s\S])"


def boundary(grammar: str) -> str:
    """The zero-width regex between two units of a grammar of disjoint character classes."""
    if not re.fullmatch(rf"{_ALTERNATIVE}(?:\|{_ALTERNATIVE})*", grammar):
        raise ValueError(f"not an alternation of character classes: {grammar}")
    found = re.findall(_ALTERNATIVE, grammar)
    for c in map(chr, range(128)):
        if sum(bool(re.match(kind, c)) for kind, _ in found) != 1:
            raise ValueError(f"{c!r} is not in exactly one class of {grammar}")
    return "|".join(f"(?<={kind})" + (f"(?!{kind})" if repeated else "") + _ANY for kind, repeated in found)


def units(text: Column, grammar: str = GRAMMARS["letters"]) -> Column:
    """Array of a text's units; none for empty and null texts."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def draws(doc_id: Column, seed: str = "1", n: int = 4) -> list[Column]:
    """The first eight-digit groups of the hex sha256 of ``seed:id`` as longs."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def fill_in_middle(
    docs: DataFrame,
    grammar: str = GRAMMARS["letters"],
    rate: int = 90,
    spm: int = 20,
    seed: str = "1",
    sentinels: tuple[str, str, str] = SENTINELS,
    doc_id: str = "doc_id",
    text: str = "text",
    prefix: str = "fim_",
) -> DataFrame:
    """The table with the units' number, form, lengths of prefix and middle (code points) and the output.

    ``rate`` percent of the texts are reordered, ``spm`` percent of these with the suffix first. The new columns are n, form,
    prefix_chars, middle_chars and output behind ``prefix``.
    """
    p_mark, s_mark, m_mark = map(F.lit, sentinels)
    own = unused("_fim", docs.columns)
    prefix = unused(prefix, docs.columns) if prefix else prefix
    a, b, u, whole, form = (F.col(f"{own}_{x}") for x in ("a", "b", "u", "text", "form"))
    n = F.size(u).cast("long")
    h1, h2, h3, h4 = draws(F.col(doc_id), seed)
    marked = F.contains(whole, p_mark) | F.contains(whole, s_mark) | F.contains(whole, m_mark)
    cut = (
        docs.withColumn(f"{own}_text", F.coalesce(F.col(text), F.lit("")))
        .withColumn(f"{own}_u", units(whole, grammar))
        .withColumns(
            {
                f"{own}_a": F.least(h1 % (n + 1), h2 % (n + 1)).cast("int"),
                f"{own}_b": F.greatest(h1 % (n + 1), h2 % (n + 1)).cast("int"),
                f"{own}_form": F.when((whole == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm, "spm").otherwise("psm"),
            }
        )
        .withColumns(
            {
                f"{own}_p": F.array_join(F.slice(u, F.lit(1), a), ""),
                f"{own}_m": F.array_join(F.slice(u, a + 1, b - a), ""),
                f"{own}_s": F.array_join(F.slice(u, b + 1, F.size(u) - b), ""),
            }
        )
    )
    p, m, s = (F.col(f"{own}_{x}") for x in "pms")
    output = F.when(form == "plain", whole).when(form == "psm", F.concat(p_mark, p, s_mark, s, m_mark, m)).otherwise(F.concat(s_mark, s, p_mark, p, m_mark, m))
    shown = {"n": n, "form": form, "prefix_chars": F.when(form != "plain", F.length(p)).cast("long"), "middle_chars": F.when(form != "plain", F.length(m)).cast("long"), "output": output}
    return cut.select(*[F.col(f"`{c}`") for c in docs.columns], *[c.alias(prefix + k) for k, c in shown.items()])


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text again, from the output and its form alone.

    A reordered text holds no sentinel, and none can begin inside a piece and end in the sentinel behind it as long as no
    sentinel's end is another's beginning; so the first of each is the mark.
    """
    p_mark, s_mark, m_mark = sentinels

    def between(left: str, right: str | None) -> Column:
        begin = F.instr(output, left) + len(left)
        return F.substr(output, begin, F.instr(output, right) - begin) if right else F.substr(output, begin)

    psm = F.concat(between(p_mark, s_mark), between(m_mark, None), between(s_mark, m_mark))
    spm = F.concat(between(p_mark, m_mark), between(m_mark, None), between(s_mark, p_mark))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
