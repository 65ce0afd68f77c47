"""Scalar column expressions (M1, S1-S23).  All built-in functions: they stay
inside whole-stage codegen, no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Unicode white space stripped at both ends (the Python str.strip
# set), for ``btrim`` (linear from both ends, no regex).
WS_CHARS = ("\t\n\u000b\u000c\r \u001c\u001d\u001e\u001f\u0085\u00a0\u1680"
            + "".join(chr(c) for c in range(0x2000, 0x200b)) + "\u2028\u2029\u202f\u205f\u3000")


def strip_ws(c) -> Column:
    """Strip leading/trailing white space of every kind (tab, newline, NBSP...);
    plain ``trim`` strips blanks only."""
    return F.btrim(_c(c), F.lit(WS_CHARS))


def normalize(c) -> Column:
    """M1: null -> '', strip white space, lowercase."""
    return F.lower(strip_ws(F.coalesce(_c(c).cast("string"), F.lit(""))))


def blank_to_null(c) -> Column:
    """'' (after stripping) -> null, else the stripped text."""
    s = strip_ws(_c(c).cast("string"))
    return F.when(s == "", F.lit(None)).otherwise(s)


def clean_cell(c) -> Column:
    """S19: 'nan', 'none', '' (case-insensitive, stripped) -> null, else stripped."""
    s = strip_ws(_c(c).cast("string"))
    return F.when(F.lower(s).isin("nan", "none", ""), F.lit(None)).otherwise(s)


def to_bool(c) -> Column:
    """true/1/t/yes (case-insensitive) -> true; anything else false; null stays null."""
    s = F.lower(strip_ws(_c(c).cast("string")))
    return F.when(s.isNull(), F.lit(None)).otherwise(s.isin("true", "1", "t", "yes"))


# ---------------------------------------------------------------- dates

def parse_date_multi(c) -> Column:
    """Date from mixed text; unparsable -> null (never raises under ANSI).

    Accepts ISO dates and date-times, ``yyyy/M/d``, ``yyyy.M.d``, ``M/d/yyyy``
    (month first, as pandas does) and ``yyyyMMdd``.
    """
    s = strip_ws(_c(c).cast("string"))
    return F.coalesce(
        s.try_cast("date"),
        F.try_to_date(s, "yyyy/M/d"),
        F.try_to_date(s, "yyyy.M.d"),
        F.try_to_date(s, "M/d/yyyy"),
        F.try_to_date(s, "yyyyMMdd"),
    )


def dotted_to_dashed(c) -> Column:
    """``YYYY.MM.DD`` -> ``YYYY-MM-DD``."""
    return F.replace(_c(c), F.lit("."), F.lit("-"))


def first10(c) -> Column:
    """S3: first 10 characters of a timestamp text."""
    return F.substring(_c(c), 1, 10)


def compact_date(c) -> Column:
    """``YYYYMMDD`` -> date, only when the text has 8 characters."""
    s = _c(c).cast("string")
    return F.when(F.length(s) == 8, F.try_to_date(s, "yyyyMMdd"))


def day_first_date(c) -> Column:
    """``DD/MM/YYYY`` -> date."""
    return F.try_to_date(strip_ws(_c(c)), "d/M/yyyy")


US_DATE_RE = r"(\d{1,2}/\d{1,2}/\d{4})"


def us_date_in_text(c) -> Column:
    """First ``M/D/YYYY`` found anywhere in the text -> date."""
    m = F.regexp_extract(_c(c), US_DATE_RE, 1)
    return F.when(m != "", F.try_to_date(m, "M/d/yyyy"))


# ------------------------------------------------------------ codes and names

# Industry product code pattern (2 digits, 3 single code letters, 2 digits).
PRODUCT_CODE_RE = r"\d{2}\s+[A-Z0-9]\s+[A-Z0-9-]\s+[A-Z0-9-]\s+\d{2}"


def product_code(c) -> Column:
    """Product code found in a line ('' when none)."""
    return F.regexp_extract(_c(c), "(" + PRODUCT_CODE_RE + ")", 1)


def industry_of(code) -> Column:
    """industry = first token of a product code."""
    return F.split(_c(code), r"\s+").getItem(0)


def name_after_code(line, code, fallback) -> Column:
    """What follows the code in its line, leading blanks/dashes/commas
    removed; when the rest is shorter than 2 characters use ``fallback`` (the
    first content line)."""
    after = F.substring(_c(line), F.instr(_c(line), _c(code)) + F.length(_c(code)), F.length(_c(line)))
    rest = strip_ws(F.regexp_replace(after, r"^[\s\-,]+", ""))
    return F.when(F.length(rest) < 2, _c(fallback)).otherwise(rest)


# Origin patterns (the "지역" label) tried in order, and the default.
ORIGIN_PATTERNS = [r"[-]?지역:\s*([가-힣a-zA-Z\s]+?)(?:\s*[-]|$)", r"지역\s*[:\-]\s*([가-힣a-zA-Z]+)"]
ORIGIN_DEFAULT = "Overseas"


def origin_from_text(c, patterns=None, default: str = ORIGIN_DEFAULT) -> Column:
    """Stripped capture of the first pattern that matches; ``default`` when
    none does or only blanks are captured."""
    caps = [F.nullif(F.regexp_extract(_c(c), "(?U)" + p, 1), F.lit("")) for p in patterns or ORIGIN_PATTERNS]
    return F.coalesce(F.nullif(strip_ws(F.coalesce(*caps)), F.lit("")), F.lit(default))


ALERT_NO_RE = r"^\d+-\d+$"


def alert_number(cell_text, link_text) -> Column:
    """The link text when it looks like ``NN-NN``, else the first ``N-N`` in the cell."""
    lt = strip_ws(_c(link_text))
    found = F.regexp_extract(_c(cell_text), r"(\d+-\d+)", 1)
    return F.when(lt.rlike(ALERT_NO_RE), lt).otherwise(F.nullif(found, F.lit("")))


def strip_id_suffix(c) -> Column:
    """Remove ``-<digits or UNKNOWN>`` and everything after it."""
    return F.regexp_replace(_c(c).cast("string"), r"-(\d+|UNKNOWN).*", "")


def replace_literals(c, pairs: list) -> Column:
    """Literal (not regex) replacements applied in order."""
    e = _c(c).cast("string")
    for a, b in pairs:
        e = F.replace(e, F.lit(a), F.lit(b))
    return e


def strip_pattern(c, pattern: str) -> Column:
    """Remove a case-insensitive pattern."""
    return F.regexp_replace(_c(c), "(?i)" + pattern, "")


def prefixed_id(prefix, seq) -> Column:
    """``prefix-seq`` or ``prefix-UNKNOWN`` when the sequence is empty."""
    p = prefix if isinstance(prefix, Column) else F.lit(prefix)
    return F.concat(p, F.lit("-"), F.coalesce(F.nullif(strip_ws(_c(seq).cast("string")), F.lit("")),
                                              F.lit("UNKNOWN")))


def bilingual(kr, en) -> Column:
    """``"kr (en)"`` when en is non-empty, else kr."""
    k = F.coalesce(strip_ws(_c(kr)), F.lit(""))
    e = F.coalesce(strip_ws(_c(en)), F.lit(""))
    return F.when(e != "", F.concat(k, F.lit(" ("), e, F.lit(")"))).otherwise(k)


def join_texts(*cols) -> Column:
    """Join texts with a space, then strip."""
    return strip_ws(F.concat_ws(" ", *[_c(c) for c in cols]))


def record_id(source, ref) -> Column:
    """SHA-256 hex of ``source::ref``; null when ref is empty (never
    deduplicates, in place of a clock-based id)."""
    r = F.nullif(_c(ref).cast("string"), F.lit(""))
    return F.when(r.isNotNull(), F.sha2(F.concat(_c(source).cast("string"), F.lit("::"), r), 256))


def split_int_pair(c, sep: str = "-"):
    """``a-b`` -> (int a, int b); malformed parts -> null."""
    parts = F.split(_c(c), sep)
    ok = F.size(parts) == 2
    a = F.when(ok, parts.getItem(0).try_cast("int"))
    b = F.when(ok, parts.getItem(1).try_cast("int"))
    return a, b


def starts_alnum(c) -> Column:
    """First character is a letter or digit (any script)."""
    return _c(c).rlike(r"^[\p{L}\p{N}]")


def split_rejects(df, raw_col: str, value: Column, out_col: str):
    """F16: (rows whose raw value could be read, rejects), both with ``out_col``;
    an empty raw value is no reject."""
    parsed = df.withColumn(out_col, value)
    bad = F.col(out_col).isNull() & (F.coalesce(strip_ws(F.col(raw_col)), F.lit("")) != "")
    return parsed.where(~bad), parsed.where(bad)
