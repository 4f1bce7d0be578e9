"""Severity of a log line: the worst of its level, HTTP status and exception type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .text import BOUNDARY, DIGIT, SPACE, SPACE_CHARS, lookup

# Weight of a log level.
LEVEL_WEIGHTS = {"FATAL": 10, "ERROR": 8, "WARN": 5, "INFO": 1, "DEBUG": 0, "TRACE": 0}

# Weight of an HTTP status.
HTTP_STATUS_WEIGHTS = {
    "200": 0, "201": 0, "202": 0, "204": 0, "206": 0,
    "301": 1, "302": 1, "303": 1, "304": 0, "307": 1, "308": 1,
    "400": 5, "401": 7, "403": 7, "404": 4, "405": 4, "406": 4, "408": 6, "409": 5, "410": 4, "411": 4,
    "412": 5, "413": 5, "414": 4, "415": 4, "416": 4, "417": 4, "422": 5, "423": 5, "424": 5, "426": 4,
    "428": 5, "429": 6, "431": 5, "451": 6,
    "500": 10, "501": 8, "502": 9, "503": 10, "504": 9, "505": 8,
}

# Exception names per family in order of precedence, with the weight of the family.
EXCEPTION_FAMILIES = [
    ("jvm", 10, [
        "OutOfMemoryError", "StackOverflowError", "VirtualMachineError", "NoClassDefFoundError",
        "ClassNotFoundException",
    ]),
    ("connection", 8, [
        "SQLException", "ConnectException", "SocketTimeoutException", "ConnectionException",
        "DatabaseException", "JDBCException", "SQLTimeoutException", "SocketException",
        "IOException", "NetworkException",
    ]),
    ("runtime", 6, [
        "NullPointerException", "IndexOutOfBoundsException", "ClassCastException",
        "ArrayIndexOutOfBoundsException", "IllegalStateException",
        "ConcurrentModificationException", "UnsupportedOperationException", "RuntimeException",
    ]),
    ("business", 4, [
        "IllegalArgumentException", "FileNotFoundException", "ValidationException",
        "BusinessException", "InvalidParameterException", "BadRequestException",
    ]),
]
UNKNOWN_EXCEPTION, UNKNOWN_EXCEPTION_WEIGHT = "UnknownException", 5

# Lower bounds of the severity buckets.
SEVERITY_BOUNDS = [("CRITICAL", 9), ("HIGH", 7), ("MEDIUM", 5), ("LOW", 1)]
SEVERITY_LEVELS = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
SEVERITY_TEXT = {
    "CRITICAL": "act at once",
    "HIGH": "act soon",
    "MEDIUM": "watch and consider action",
    "LOW": "within the normal range",
    "INFO": "informational, may be ignored",
}

# A bare number of three digits (after HTTP/x or not), or one that follows a keyword.
STATUS_PATTERN = (
    f"(?iu){BOUNDARY}(?:HTTP/[{DIGIT}.]+)?{SPACE}*{DIGIT}{{3}}{BOUNDARY}"
    f"|(?:status|code|response|returned)[:{SPACE_CHARS}]+{DIGIT}{{3}}"
)


def exception_weights() -> dict[str, int]:
    return {name: weight for _, weight, names in EXCEPTION_FAMILIES for name in names}


def level_weight(level: Column) -> Column:
    return F.coalesce(lookup(LEVEL_WEIGHTS)[F.upper(level)], F.lit(0))


def http_status(message: Column) -> Column:
    """``HTTP_nnn`` for the first status in the message if that status carries weight, else null.

    Every way to match ends in the three digits, so the tail of the match is the status.
    """
    code = F.right(F.regexp_extract(message, STATUS_PATTERN, 0), F.lit(3))
    return F.when(lookup(HTTP_STATUS_WEIGHTS)[code] > 0, F.concat(F.lit("HTTP_"), code))


def http_status_weight(status: Column) -> Column:
    return F.coalesce(lookup(HTTP_STATUS_WEIGHTS)[F.right(status, F.lit(3))], F.lit(0))


def exception_type(message: Column) -> Column:
    """Exception name by family precedence; a known name in the wrong case does not count."""
    weights = lookup(exception_weights())
    found = []
    for _, _, names in EXCEPTION_FAMILIES:
        name = F.regexp_extract(message, f"(?iu)({'|'.join(names)})", 1)
        found.append(F.when(weights[name] > 0, name))
    other = F.when(message.contains("Exception") | message.contains("Error"), F.lit(UNKNOWN_EXCEPTION))
    folded = F.lower(message)
    # All names contain one of the two words: most lines skip the searches.
    return F.when(folded.contains("exception") | folded.contains("error"), F.coalesce(*found, other))


def exception_weight(name: Column) -> Column:
    known = lookup({**exception_weights(), UNKNOWN_EXCEPTION: UNKNOWN_EXCEPTION_WEIGHT})
    return F.coalesce(known[name], F.lit(0))


def severity_bucket(score: Column) -> Column:
    level = F
    for name, bound in SEVERITY_BOUNDS:
        level = level.when(score >= bound, name)
    return level.otherwise("INFO")


def with_severity(logs: DataFrame) -> DataFrame:
    """Severity score, bucket and its three parts, one row in, one row out."""
    return (
        logs
        .withColumns({
            "level_weight": level_weight(F.coalesce(F.col("level"), F.lit("INFO"))),
            "http_status_code": http_status(F.col("message")),
            "exception_type": exception_type(F.col("message")),
        })
        .withColumns({
            "http_status_weight": http_status_weight(F.col("http_status_code")),
            "exception_weight": exception_weight(F.col("exception_type")),
        })
        .withColumn("severity_score", F.greatest("level_weight", "http_status_weight", "exception_weight"))
        .withColumn("severity_level", severity_bucket(F.col("severity_score")))
        .withColumn("severity_description", lookup(SEVERITY_TEXT)[F.col("severity_level")])
    )


def severity_score(level: Column, message: Column) -> Column:
    """Only the score, for operators that need nothing else."""
    return F.greatest(
        level_weight(level),
        http_status_weight(http_status(message)),
        exception_weight(exception_type(message)),
    )
