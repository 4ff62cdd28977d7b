"""Column expressions over names, test identifiers and generated text.

All are Catalyst built-ins (string functions, regex, higher-order array
functions), so they run inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
# Words that never name a column when the column is guessed from a test name.
COLUMN_STOP_WORDS = ["test", "check", "null", "duplicate", "format", "valid", "quality"]
# Keyword -> column rules applied to a lower-cased test name, in order.
COLUMN_KEYWORDS = [
    (("email",), "customer_email"),
    (("customer", "id"), "customer_id"),
    (("id",), "customer_id"),
    (("name",), "customer_name"),
]
UNKNOWN_COLUMN = "unknown column"
# Lead-in phrases removed from generated messages that carry no quoted text.
MESSAGE_PREFIXES = [
    "Here is a specific, detailed explanation of the data quality issue:",
    "Here is a specific",
    "detailed explanation of the data quality issue:",
    "detailed explanation of the data quality issue",
]
# Labels stripped from the front of a generated fix, in order.
FIX_LABELS = ["SQL Fix:", "Fix:", "Solution:", "SQL:", "sql"]
# Statement keywords that start the SQL part of a generated fix.
SQL_KEYWORDS = ["UPDATE", "DELETE", "INSERT", "ALTER", "CREATE", "DROP"]
METRICS_MARKER = "METRICS:"
METRIC_KEYS = ["confidence_score", "expected_rows_affected", "hours_saved"]
METRIC_DEFAULTS = {"confidence_score": 50, "expected_rows_affected": 0, "hours_saved": 0}
# Issue classes used for scoring (by test name) and for text (first test).
ISSUE_NULL, ISSUE_DUP, ISSUE_FORMAT, ISSUE_UNKNOWN = "null_values", "duplicates", "format_mismatch", "unknown"
LABEL_NULL, LABEL_DUP, LABEL_FORMAT, LABEL_OTHER = ("missing values", "duplicate records", "format mismatch",
                                                    "data quality")
FOUR_PART_NAME = (r"\b([a-zA-Z_][a-zA-Z0-9_]*)\.([a-zA-Z_][a-zA-Z0-9_]*)\."
                  r"([a-zA-Z_][a-zA-Z0-9_]*)\.([a-zA-Z_][a-zA-Z0-9_]*)\b")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# White space removed by ``strip_ws``: the Latin-1 characters Python's str.strip() removes.
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
WS_CLASS = r"[ \t\n\r\x0B\f\x1C-\x1F\x85\xA0]"          # the same set as a regex class (Java)
WS_LINE = r"[ \t\r\x0B\f\x1C-\x1F\x85\xA0]"           # ... without the line break


def strip_ws(c: Column | str) -> Column:
    """Remove leading and trailing white space (built-in btrim, no regex)."""
    return F.btrim(_c(c), F.lit(WHITESPACE))


# ---------------------------------------------------------------- names
def last_part(c: Column | str) -> Column:
    """Text after the last dot (the whole text when there is no dot)."""
    return F.element_at(F.split(_c(c), r"\."), -1)


def fqn_parts(c: Column | str) -> list[Column]:
    """service, database, schema, table of a dotted name with defaults
    'default', 'default', 'mart', 'customers' for missing parts."""
    parts = F.split(_c(c), r"\.")
    n = F.size(parts)
    pick = lambda i, dflt: F.when(n > i, F.get(parts, i)).otherwise(F.lit(dflt))
    return [pick(0, "default").alias("service"), pick(1, "default").alias("database"),
            pick(2, "mart").alias("schema"), pick(3, "customers").alias("table")]


def rewrite_fqn(sql: Column | str) -> Column:
    """Every four-part name service.database.schema.table becomes schema.table."""
    return F.regexp_replace(_c(sql), FOUR_PART_NAME, "$3.$4")


# ---------------------------------------------------------------- classification
def classify_issue(test_name: Column | str) -> Column:
    """Scoring class of one test by its name: null > duplicate > format/mismatch."""
    n = F.lower(F.coalesce(_c(test_name), F.lit("")))
    return (F.when(n.contains("null"), F.lit(ISSUE_NULL))
            .when(n.contains("duplicate"), F.lit(ISSUE_DUP))
            .when(n.contains("format") | n.contains("mismatch"), F.lit(ISSUE_FORMAT))
            .otherwise(F.lit(ISSUE_UNKNOWN)))


def issue_label(test_name: Column | str, test_fqn: Column | str) -> Column:
    """Text class of the first test: null/duplicate by name or FQN, format by name."""
    n = F.lower(F.coalesce(_c(test_name), F.lit("")))
    f = F.lower(F.coalesce(_c(test_fqn), F.lit("")))
    return (F.when(n.contains("null") | f.contains("null"), F.lit(LABEL_NULL))
            .when(n.contains("duplicate") | f.contains("duplicate"), F.lit(LABEL_DUP))
            .when(n.contains("format") | n.contains("mismatch"), F.lit(LABEL_FORMAT))
            .otherwise(F.lit(LABEL_OTHER)))


def issue_column(test_fqn: Column | str, test_name: Column | str, table_fqn: Column | str) -> Column:
    """Column an issue is about.

    1. part 5 of the test FQN when it has >= 5 parts, is non-empty and is not
       the table's own name;
    2. keyword rules on the lower-cased test name;
    3. first word ([a-z_]+) of the test name that is no stop word and has
       more than 2 letters;
    4. 'unknown column'.
    """
    fqn = F.coalesce(_c(test_fqn), F.lit(""))
    name = F.lower(F.coalesce(_c(test_name), F.lit("")))
    table_name = last_part(F.coalesce(_c(table_fqn), F.lit("")))
    parts = F.split(fqn, r"\.")
    part5 = F.get(parts, 4)
    from_fqn = F.when((fqn != "") & (F.size(parts) >= 5) & (part5 != "") & (part5 != table_name), part5)
    rule = None
    for words, col in COLUMN_KEYWORDS:
        cond = None
        for w in words:
            cond = name.contains(w) if cond is None else cond & name.contains(w)
        rule = F.when(cond, F.lit(col)) if rule is None else rule.when(cond, F.lit(col))
    stop = F.array(*[F.lit(w) for w in COLUMN_STOP_WORDS])
    words = F.regexp_extract_all(name, F.lit("([a-z_]+)"), 1)
    cand = F.filter(words, lambda w: (~F.array_contains(stop, w)) & (F.length(w) > 2))
    return F.coalesce(from_fqn, rule, F.get(cand, 0), F.lit(UNKNOWN_COLUMN))


# ---------------------------------------------------------------- generated text
def with_clean_message(df, col: str, out: str):
    """Add ``out``: the first quoted passage of ``col`` when there is one; else
    ``col`` with known lead-in phrases removed (white space trimmed after each
    removal).  Then trim white space, surrounding double quotes, white space.

    Each step is its own projected column, so no step re-embeds the whole
    expression of the step before it.
    """
    src = F.col(col)
    d = df.withColumn("_cm0", src)
    for i, p in enumerate(MESSAGE_PREFIXES):
        cur = F.col(f"_cm{i}")
        d = d.withColumn(f"_cm{i + 1}", F.when(cur.contains(p), strip_ws(F.replace(cur, F.lit(p), F.lit(""))))
                         .otherwise(cur))
    last = F.col(f"_cm{len(MESSAGE_PREFIXES)}")
    picked = F.when(src.rlike(r'"[^"]+"'), F.regexp_extract(src, r'"([^"]+)"', 1)).otherwise(last)
    d = d.withColumn(out, strip_ws(F.regexp_replace(strip_ws(picked), r'^"+|"+$', "")))
    return d.drop(*[f"_cm{i}" for i in range(len(MESSAGE_PREFIXES) + 1)])


def has_metrics(text: Column | str) -> Column:
    return _c(text).contains(METRICS_MARKER)


def fix_sql_part(text: Column | str) -> Column:
    """SQL part of a generated answer: text before the marker, labels removed,
    cut at the earliest statement keyword that stands as a whole word.

    Every step is one regex over the previous value (referenced once), so the
    expression stays linear in the number of labels.
    """
    t = _c(text)
    head = F.when(has_metrics(t), strip_ws(F.split_part(t, F.lit(METRICS_MARKER), F.lit(1)))).otherwise(t)
    # labels are tried in order, each once; any label found means the rest is trimmed.
    # One anchored regex does the whole chain: (?=any label)(label1\s*)?...(labelN\s*)?
    labels = [_re_quote(x) for x in FIX_LABELS]
    chain = "(?=" + "|".join(labels) + ")" + "".join(f"(?:{x}{WS_CLASS}*)?" for x in labels)
    head = F.regexp_replace(head, r"(?s)^" + chain + r"(.*?)" + WS_CLASS + "*$", "$1")
    kw = "|".join(SQL_KEYWORDS)
    pos = F.regexp_instr(head, F.lit(rf"(?i)\b({kw})\b"))
    return F.when(pos > 0, strip_ws(F.substr(head, pos))).otherwise(head)


def _re_quote(s: str) -> str:
    return "".join("\\" + ch if ch in r".^$*+?{}[]\|()" else ch for ch in s)


def metric_block(text: Column | str) -> Column:
    """Text between the first and the second metrics marker."""
    return F.split_part(_c(text), F.lit(METRICS_MARKER), F.lit(2))


def metric_from_block(text: Column | str, block: Column, key: str) -> Column:
    """Last line ``key: <int>[: ...]`` of the block whose value (text between the
    first and second colon, trimmed) is a whole integer; else the default."""
    pattern = rf"(?md)^{WS_LINE}*{key}:{WS_LINE}*([+-]?[0-9]+){WS_LINE}*(?::.*)?$"
    found = F.regexp_extract_all(block, F.lit(pattern), 1)
    parsed = F.try_element_at(found, F.lit(-1)).try_cast("bigint")
    dflt = F.lit(METRIC_DEFAULTS[key]).cast("bigint")
    return F.when(has_metrics(text), F.coalesce(parsed, dflt)).otherwise(dflt)
