"""Spring Boot log lines -> typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .text import DIGIT, SPACE, SPACE_CHARS, WORD, contains_any, strip

# Words that mark a line as an error, compared in lower case.
ERROR_KEYWORDS = [
    "Exception", "Error", "Failed", "Fatal", "Critical", "Timeout", "Connection refused",
    "OutOfMemoryError", "NullPointerException", "StackOverflowError", "ClassNotFoundException",
    "NoClassDefFoundError", "SQLException", "IOException", "SocketException",
]
# Levels that mark a line as an error.
ERROR_LEVELS = ["ERROR", "FATAL"]

# date time.mmm LEVEL pid --- [thread] class : message
_TIME = f"{DIGIT}{{4}}-{DIGIT}{{2}}-{DIGIT}{{2}}{SPACE}+{DIGIT}{{2}}:{DIGIT}{{2}}:{DIGIT}{{2}}\\.{DIGIT}{{3}}"
LINE_PATTERN = (
    f"(?s)^({_TIME}){SPACE}+({WORD}+){SPACE}+({DIGIT}+){SPACE}+---{SPACE}+"
    f"\\[([^\\]]+)\\]{SPACE}+([^{SPACE_CHARS}:]+){SPACE}*:?{SPACE}*(.*)$"
)


def is_error(level: Column, message: Column) -> Column:
    return level.isin(ERROR_LEVELS) | contains_any(F.lower(message), [k.lower() for k in ERROR_KEYWORDS])


def has_exception(message: Column) -> Column:
    return message.contains("Exception") | message.contains("Error")


def event_time(text: Column) -> Column:
    """Timestamp without zone, null when the text is not a calendar time.

    Date and time have a fixed width; whatever blanks stand between them count as one.
    """
    return F.concat(F.left(text, F.lit(10)), F.lit(" "), F.right(text, F.lit(12))).try_cast("timestamp_ntz")


def exception_name(message: Column) -> Column:
    """First ``...Exception`` / ``...Error`` word, null if there is none."""
    return F.nullif(F.regexp_extract(message, f"({WORD}+Exception|{WORD}+Error)", 1), F.lit(""))


def parse_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Typed log table from raw lines; lines of another shape are dropped.

    The pattern is evaluated as one rewrite into newline-separated fields (a line cannot contain a
    newline) instead of one extraction per field.  The one-row ``explode`` fixes the fields as columns:
    later filters are not pushed below it, which would evaluate the pattern once more per use.
    """
    extra = [c for c in lines.columns if c != col]
    fields = F.split(F.regexp_replace(strip(F.col(col)), LINE_PATTERN, "$1\n$2\n$3\n$4\n$5\n$6"), "\n", 6)
    parts = lines.select(*extra, F.explode(F.array(fields)).alias("_f")).filter(F.size("_f") == 6)
    message = F.col("message")
    return (
        parts.select(
            event_time(F.col("_f")[0]).alias("timestamp"),
            F.col("_f")[1].alias("level"),
            F.col("_f")[2].alias("pid"),
            strip(F.col("_f")[3]).alias("thread"),
            F.col("_f")[4].alias("class_path"),
            F.col("_f")[5].alias("message"),
            *extra,
        )
        .withColumns({
            "is_error": is_error(F.col("level"), message),
            "message_length": F.length(message),
            "has_exception": has_exception(message),
        })
    )


def with_calendar(logs: DataFrame) -> DataFrame:
    """Hour, minute and date of the event time."""
    return logs.withColumns({
        "hour": F.hour("timestamp"),
        "minute": F.minute("timestamp"),
        "date": F.to_date("timestamp"),
    })


def time_floor(col: Column | str, width: str = "10 minutes") -> Column:
    """Start of the fixed-width window that holds the event time."""
    return F.window(col, width)["start"]
