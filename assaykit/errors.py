"""Errors, what to do about them, and the exit codes that they map to."""

from __future__ import annotations

from dataclasses import dataclass


class AssayError(Exception):
    """Base of this package's errors. category is a key of EXIT_CODES; fatal ones end the run, others one rule."""

    category = "generic"
    fatal = True

    def __init__(self, message: str, **context):
        super().__init__(message)
        self.context = context


class RuleError(AssayError):
    category = "rule_syntax_error"


class SourceError(AssayError):
    category = "invalid_connection"


class ContractError(AssayError):
    category = "usage_error"


class EngineError(AssayError):
    """The session or the source is unusable."""

    category = "system_generic"


class OperationError(AssayError):
    category = "execution_generic"
    fatal = False


class RuleExecutionError(AssayError):
    """One rule could not be carried out."""

    category = "execution_generic"
    fatal = False


#: The exit code of each kind of error.
EXIT_CODES = {
    "success": 0,
    "generic": 1,
    "connectivity": 2,
    "authorization": 3,
    "configuration": 4,
    "sql_syntax": 5,
    "execution_generic": 6,
    "table_not_found": 7,
    "column_not_found": 8,
    "query_timeout": 9,
    "data_type_mismatch": 10,
    "data_access_denied": 11,
    "system_generic": 12,
    "file_not_found": 20,
    "permission_denied": 21,
    "file_format_error": 22,
    "config_file_error": 23,
    "usage_error": 24,
    "file_system_error": 25,
    "cli_generic": 26,
    "invalid_connection": 30,
    "unsupported_type": 31,
    "rule_syntax_error": 32,
    "unsupported_rule": 33,
    "schema_generic": 34,
}

_ADVICE = {
    "connectivity": "check that the source can be reached",
    "authorization": "check user name and password",
    "configuration": "check the settings",
    "sql_syntax": "check the filter condition",
    "table_not_found": "check the table's name",
    "column_not_found": "check the column's name",
    "data_type_mismatch": "check that the rule suits the column's type",
    "data_access_denied": "ask for the right to read the data",
    "file_not_found": "check the path",
    "permission_denied": "check the file's permissions",
    "file_format_error": "check the file's content",
    "usage_error": "see --help",
    "rule_syntax_error": "check the rule's parameters",
    "unsupported_rule": "see --help for the known rules",
    "invalid_connection": "check the source",
    "unsupported_type": "see the supported sources",
}

#: Spark's error classes and words in messages, in order of the search.
_SIGNS = (
    ("column_not_found", ("UNRESOLVED_COLUMN", "column not found", "no such column")),
    ("table_not_found", ("TABLE_OR_VIEW_NOT_FOUND", "table not found", "no such table")),
    ("file_not_found", ("PATH_NOT_FOUND", "No such file", "does not exist")),
    ("sql_syntax", ("PARSE_SYNTAX_ERROR", "PARSE_", "syntax error")),
    ("data_type_mismatch", ("DATATYPE_MISMATCH", "CAST_INVALID_INPUT", "type mismatch")),
    ("data_access_denied", ("permission denied", "access denied", "AccessControl")),
    ("authorization", ("authentication", "password")),
    ("query_timeout", ("timed out", "timeout")),
    ("connectivity", ("connection refused", "Communications link", "unknown host", "No suitable driver", "ClassNotFoundException")),
)


@dataclass(frozen=True)
class Classified:
    category: str
    exit_code: int
    message: str
    advice: str


def classify(error: BaseException) -> Classified:
    """The kind of an error, from its type, else from what its message says."""
    text = str(error)
    if isinstance(error, AssayError):
        category = error.category
    elif isinstance(error, FileNotFoundError):
        category = "file_not_found"
    elif isinstance(error, PermissionError):
        category = "permission_denied"
    elif isinstance(error, (UnicodeDecodeError, ValueError)) and not isinstance(error, AssayError):
        category = "file_format_error"
    elif isinstance(error, OSError):
        category = "file_system_error"
    else:
        low = text.lower()
        category = next((c for c, signs in _SIGNS if any(s.lower() in low for s in signs)), "generic")
    return Classified(category, EXIT_CODES[category], text.splitlines()[0] if text else type(error).__name__, _ADVICE.get(category, ""))
