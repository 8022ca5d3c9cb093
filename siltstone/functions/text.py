"""Scalar text functions as Column expressions; all stay in the JVM.

A column may be given by name or as a Column. White space is Unicode white space unless a name says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"(?U)\s+"

# Labels, separators and patterns that results depend on.
MAJORS = ["儿科", "内科", "外科", "妇产科", "男科", "肿瘤科"]
UNTITLED = "untitled"
NO_SPECIALTY = "未分类专题"
GUIDE_PREFIX = r"^临床诊疗指南\s*[—_-]?\s*"
AUTHOR_SUFFIX = r"_[^_]+著$"
VOLUME = "分册"
QA_LABEL = r"(?i)^(问题|答案|回答|user|assistant|Q|A|Question|Answer|问|答)[\t:： ]+"
VALUE_SEPARATORS = r"[、,，;；|]"
ENGLISH_CHARS = r"[`a-zA-Z0-9\s.,':;/\"?<>!()\-]"
NOT_BULLET = r"^(0|[0-9]+ +[0-9~个只-]|[0-9]+\.{2,})"
QUERY_SPECIALS = r"""([:{}/\[\]\-*?"()|+~^])"""
# The patterns of question words and fillers, in the order in which they are taken out, with what stands for them.
QUESTION_NOISE = [
    (r"是*(怎么办|什么样的|哪家|一下|那家|请问|啥样|咋样了|什么时候|何时|何地|何人|是否|是不是|多少|哪里|怎么|哪儿|怎么样|如何|哪些|是啥|啥是|啊|吗|呢|吧|咋|什么|有没有|呀|谁|哪位|哪个)是*", ""),
    (r"(^| )(what|who|how|which|where|why)('re|'s)? ", " "),
    (
        r"(^| )('s|'re|is|are|were|was|do|does|did|don't|doesn't|didn't|has|have|be|there|you|me|your|my|mine|just|please|may|i|should|would|wouldn't|will|won't|done|go|for|with|so|the|a|an|by|i'm|it's|he's|she's|they|they're|you're|as|by|on|in|at|up|out|down|of|to|or|and|if) ",
        " ",
    ),
]
HIGHLIGHT_EDGE = r"""[ .?/'"()!,:;-]"""
HTML_ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(c: Column | str) -> Column:
    """Null becomes empty, runs of white space one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(_c(c), F.lit("")), WS, " "))


def collapse_wide(c: Column | str) -> Column:
    """As X1 after turning ideographic spaces into spaces."""
    return collapse(F.replace(F.coalesce(_c(c), F.lit("")), F.lit("　"), F.lit(" ")))


def safe_name(c: Column | str, longest: int = 40) -> Column:
    """A name fit for paths."""
    x = F.regexp_replace(collapse_wide(c), r'[\\/:*?"<>|]+', "_")
    x = F.btrim(F.regexp_replace(F.regexp_replace(x, WS, ""), "_+", "_"), F.lit("_"))
    return F.when(x == "", F.lit(UNTITLED)).otherwise(F.substring(x, 1, longest))


def file_stem(c: Column | str) -> Column:
    return F.regexp_replace(F.substring_index(_c(c), "/", -1), r"(?<=.)\.[^.]*$", "")


def document_title(c: Column | str) -> Column:
    """The file's stem, or its name if that is blank."""
    x = collapse_wide(file_stem(c))
    return F.when(x == "", _c(c)).otherwise(x)


def specialty(c: Column | str) -> Column:
    """The title without series prefix, author and year."""
    x = F.regexp_replace(document_title(c), GUIDE_PREFIX, "")
    x = F.regexp_replace(F.regexp_replace(x, AUTHOR_SUFFIX, ""), r"[0-9]{4}$", "")
    x = F.btrim(F.regexp_replace(x, r"\.(PDF|pdf)", ""), F.lit(" _-"))
    x = collapse_wide(F.when(x.endswith(VOLUME), F.substring(x, F.lit(1), F.length(x) - 2)).otherwise(x))
    return F.when(x == "", F.lit(NO_SPECIALTY)).otherwise(x)


def heading_text(path: Column | str) -> Column:
    """The non-blank headings joined by ``>``."""
    return F.array_join(F.filter(F.transform(_c(path), collapse_wide), lambda x: x != ""), " > ")


def stable_id(*parts: Column | str) -> Column:
    """md5 of the parts joined by colons."""
    return F.md5(F.concat_ws(":", *[_c(p).cast("string") for p in parts]))


def shard_name(specialty_name: Column | str, chapter: Column | str, part: Column | str) -> Column:
    """Prefix, names of 24 characters at most, part of three digits."""
    return F.format_string("pdf_%s_%s_p%03d", safe_name(specialty_name, 24), safe_name(F.coalesce(F.nullif(_c(chapter), F.lit("")), F.lit("正文")), 24), _c(part).cast("int"))


def shard_path(name: Column | str) -> Column:
    return F.concat(F.lit("normalized_shards/"), _c(name), F.lit(".jsonl"))


def major(c: Column | str, majors: list[str] | None = None) -> Column:
    """The first major the file name starts with, else its stem."""
    return F.coalesce(*[F.when(_c(c).startswith(m), F.lit(m)) for m in majors or MAJORS], file_stem(c))


def tighten(c: Column | str) -> Column:
    """No spaces behind opening marks nor before closing ones."""
    x = F.regexp_replace(_c(c), r"(?i)([^a-z0-9.,\)>]) +([^ ])", "$1$2")
    return F.regexp_replace(x, r"(?i)([^ ]) +([^a-z0-9.,\(<])", "$1$2")


def strip_fence(c: Column | str) -> Column:
    """X11: a text without the Markdown fence around it."""
    x = F.regexp_replace(_c(c), r"^\s*```markdown\s*\n?", "")
    return F.regexp_replace(F.regexp_replace(x, r"\n?\s*```\s*$", ""), r"^\s+|\s+$", "")


def to_float(c: Column | str) -> Column:
    """A double; what can't be read is minus infinity."""
    return F.coalesce(_c(c).try_cast("double"), F.lit(float("-inf")))


def tab_floats(c: Column | str) -> Column:
    return F.transform(F.split(_c(c), "\t"), to_float)


def clamp_percent(c: Column | str) -> Column:
    """An overlap in per cent, 0 to 90; fractions below 1 count as shares."""
    x = F.coalesce(_c(c).try_cast("double"), F.lit(0.0))
    return F.least(F.lit(90), F.greatest(F.lit(0), F.when((x > 0) & (x < 1), x * 100).otherwise(x).cast("int")))


def is_english(c: Column | str) -> Column:
    """Over 80 % of the characters are of English text."""
    return F.coalesce(F.try_divide(F.length(_c(c)) - F.length(F.regexp_replace(_c(c), ENGLISH_CHARS, "")), F.length(_c(c))) > 0.8, F.lit(False))


def is_chinese(c: Column | str) -> Column:
    """Over 20 % of the characters are CJK ideographs."""
    return F.coalesce(F.try_divide(F.length(_c(c)) - F.length(F.regexp_replace(_c(c), r"[一-鿿]", "")), F.length(_c(c))) > 0.2, F.lit(False))


def is_chinese_query(c: Column | str) -> Column:
    """Three words or fewer, or 70 % of the words are not Latin letters alone."""
    w = F.split(_c(c), r"[ \t]+")
    return (F.size(w) <= 3) | (F.size(F.filter(w, lambda x: ~x.rlike(r"^[a-zA-Z]+$"))) >= 0.7 * F.size(w))


def strip_qa_label(c: Column | str) -> Column:
    return F.regexp_replace(F.trim(_c(c)), QA_LABEL, "")


def _entities(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), HTML_ENTITIES.items(), c)


def html_text(c: Column | str) -> Column:
    """A fragment's text; breaks, paragraphs and divisions end lines before white space collapses."""
    x = F.regexp_replace(_c(c), r"(?is)<br\s*/?>|</p\s*>|</div\s*>", "\n")
    return collapse_wide(_entities(F.regexp_replace(x, r"(?s)<[^>]+>", " ")))


def html_table_text(c: Column | str) -> Column:
    """A table's rows, cells joined by a pipe; without rows the text of the whole."""
    rows = F.regexp_extract_all(_c(c), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda r: F.filter(F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), html_text), lambda x: x != "")
    text = F.array_join(F.filter(F.transform(rows, lambda r: F.array_join(cells(r), " | ")), lambda x: x != ""), "\n")
    return F.when(text == "", html_text(c)).otherwise(text)


def markdown_table_text(c: Column | str) -> Column:
    """The rows of a pipe table without its rules."""
    lines = F.filter(F.transform(F.split(_c(c), "\n"), lambda y: F.trim(y)), lambda x: x.startswith("|"))
    cells = lambda x: F.transform(F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|"), collapse_wide)
    kept = F.filter(F.transform(lines, cells), lambda r: ~F.forall(r, lambda x: x.rlike(r"^(:?-+:?)?$")))
    return F.array_join(F.filter(F.transform(kept, lambda r: F.array_join(F.filter(r, lambda x: x != ""), " | ")), lambda x: x != ""), "\n")


def strip_table_tags(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), r"(?i)</?(table|td|caption|tr|th)( [^<>]{0,12})?>", " ")


def tokens(c: Column | str) -> Column:
    """Lower-cased runs of letters, digits and underscores, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(c), F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def fine_tokens(c: Column | str) -> Column:
    """Tokens, with runs of CJK ideographs cut into overlapping pairs."""
    pairs = lambda t: F.when(t.rlike(r"^[一-鿿]{3,}$"), F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))).otherwise(F.array(t))
    return F.flatten(F.transform(tokens(c), pairs))


def half_width(c: Column | str) -> Column:
    """Full-width Latin characters as half-width ones."""
    wide = "".join(chr(x) for x in range(0xFF01, 0xFF5F)) + "　"
    return F.translate(_c(c), wide, "".join(chr(x) for x in range(0x21, 0x7F)) + " ")


def token_count(c: Column | str) -> Column:
    """An estimate without a vocabulary: Latin words, CJK characters and other marks count one each."""
    return F.size(F.regexp_extract_all(F.coalesce(_c(c), F.lit("")), F.lit(r"[A-Za-z0-9_À-ɏ]+|[^\sA-Za-z0-9_À-ɏ]"), F.lit(0)))


def first_tokens(c: Column | str, n: Column) -> Column:
    """The text up to the end of its ``n``-th token, as ``token_count`` counts them."""
    pieces = F.regexp_extract_all(F.coalesce(_c(c), F.lit("")), F.lit(r"\s*(?:[A-Za-z0-9_À-ɏ]+|[^\sA-Za-z0-9_À-ɏ])"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), n), "")


def split_values(c: Column | str) -> Column:
    """A combined value's distinct trimmed parts, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(_c(c), F.lit("")), VALUE_SEPARATORS), lambda y: F.trim(y)), lambda x: x != ""))


def merge_meta(old: Column | str, new: Column | str) -> Column:
    """Maps of lists: lists are extended without repeats, missing keys added."""
    empty = F.array().cast("array<string>")
    return F.map_zip_with(_c(old), _c(new), lambda k, a, b: F.array_distinct(F.concat(F.coalesce(a, empty), F.coalesce(b, empty))))


def value_type(c: Column | str) -> Column:
    """Number, time or string of a value's text."""
    x = F.trim(_c(c))
    return F.when(x.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), "number").when(x.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}:[0-9]{2})?$"), "time").otherwise("string")


def human_bytes(c: Column | str) -> Column:
    """Bytes with a unit; fewer decimals for larger numbers."""
    n = _c(c).cast("double")
    unit = F.least(F.lit(5), F.floor(F.log(1024.0, F.greatest(n, F.lit(1.0))) + 1e-12)).cast("int")
    x = n / F.pow(F.lit(1024.0), unit)
    name = F.element_at(F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB", "TB", "PB")]), unit + 1)
    number = F.when((unit == 0) | (x >= 100), F.format_string("%.0f", F.bround(x, 0))).when(x >= 10, F.format_string("%.1f", F.bround(x, 1))).otherwise(F.format_string("%.2f", F.bround(x, 2)))
    return F.concat(number, F.lit(" "), name)


def tail_lines(c: Column | str, most: int) -> Column:
    """At most the last ``most`` characters, from a line's start where there is one."""
    x = F.substring(_c(c), -most, most)
    return F.when(F.length(_c(c)) <= most, _c(c)).when(F.locate("\n", x) > 0, F.regexp_replace(x, r"(?s)^[^\n]*\n", "")).otherwise(x)


def first_json(c: Column | str) -> Column:
    """The outermost braces of a model's answer, if they hold JSON."""
    x = F.regexp_extract(F.regexp_replace(_c(c), r"(?s)```(json)?", ""), r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(F.nullif(x, F.lit(""))).isNotNull(), x)


def latin_digits(c: Column | str) -> Column:
    """Arabic-Indic digits as Latin ones."""
    return F.translate(_c(c), "".join(chr(b + i) for b in (0x0660, 0x06F0) for i in range(10)), "0123456789" * 2)


def first_term(c: Column | str, terms: list[str], default: str = "other") -> Column:
    """The first of the terms that the text contains."""
    return F.coalesce(*[F.when(_c(c).contains(t), F.lit(t)) for t in terms], F.lit(default))


def markdown_row(*cells: Column | str) -> Column:
    """A pipe-table row; nulls are blank and midnight times are dropped."""
    return F.concat(F.lit("|"), F.concat_ws("|", *[F.regexp_replace(F.coalesce(_c(c).cast("string"), F.lit(" ")), r"[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?Z?$", "") for c in cells]), F.lit("|"))


def qa_text(title: Column | str, ask: Column | str, answer: Column | str) -> Column:
    """A question with its title and answer, one labelled line each."""
    has = collapse(title) != ""
    return F.concat_ws("\n", F.when(has, F.concat(F.lit("标题："), collapse(title))), F.concat(F.lit("问题："), collapse(ask)), F.concat(F.lit("回答："), collapse(answer)))


def escape_query(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.replace(_c(c), F.lit("'"), F.lit("")), QUERY_SPECIALS, r"\\$1"))


def strip_question_words(c: Column | str) -> Column:
    """A question without question words and fillers of Chinese and English; unchanged if nothing is left."""
    x = _c(c)
    for pattern, instead in QUESTION_NOISE:
        x = F.regexp_replace(x, f"(?iu){pattern}", instead)
    return F.when(x == "", _c(c)).otherwise(x)


def space_scripts(c: Column | str) -> Column:
    """Spaces between Latin and CJK runs."""
    x = F.regexp_replace(_c(c), r"([A-Za-z][0-9]*)([一-龥])", "$1 $2")
    return F.regexp_replace(x, r"([一-龥])([A-Za-z])", "$1 $2")


def emphasise(c: Column | str, keywords: Column) -> Column:
    """Keywords between punctuation or spaces are set in em tags, whatever their case; longer ones first."""
    quoted = F.transform(F.array_sort(keywords, lambda a, b: F.length(b) - F.length(a)), lambda k: F.regexp_replace(k, r"([^\p{L}\p{N} ])", r"\\$1"))
    return F.aggregate(quoted, _c(c), lambda t, k: F.regexp_replace(t, F.concat(F.lit(f"(?i)(^|{HIGHLIGHT_EDGE})("), k, F.lit(f")({HIGHLIGHT_EDGE}|$)")), F.lit("$1<em>$2</em>$3")))


def highlight(c: Column | str, keywords: Column) -> Column:
    """The sentences in which a keyword was set in em tags, joined by dots; null if there is none."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(_c(c), "[\r\n]", " "), "[.?!;]"), lambda y: F.trim(y)), lambda x: x != "")
    found = F.filter(F.transform(parts, lambda p: emphasise(p, keywords)), lambda x: x.contains("<em>"))
    return F.when(F.size(found) > 0, F.array_join(found, "..."))


def sentences(c: Column | str) -> Column:
    """Sentences with their end marks."""
    return F.filter(F.split(_c(c), r"(?<=[。？！!?;；:\n])"), lambda x: x != "")
