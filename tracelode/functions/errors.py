"""Whether a result is an error, and of which class, by the kind of harness that recorded it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import error_marker

# Marks that harnesses leave in outputs and in stderr.
TIMED_OUT = r"(?m)^(?:timed out: |sandbox error: command timed out)"
EXITED = r"Process exited with code (-?\d+)"
EXIT_HEADER = r"(?m)^Exit code: (-?\d+)"
RETURNED = r"(?:returncode|return code|exited with)\D{0,3}(?!0\b)(\d+)"
REFUSED = ("cc_permission_denied", "cc_interrupt_reject")

#: Harness families: whose native flag decides, with which marks besides.
FAMILIES = ("marked", "headed", "native", "two_level", "stderr", "exit_code")


def error_class(family: Column, text: Column, stderr: Column, native: Column, exit_code: Column) -> Column:
    """A struct (primary, class); primary is null where a family has no error definition.

    marked: the native flag, refusals apart; headed: the flag, else a non-zero code in the output's first
    600 characters; native: the flag alone; two_level: the flag (tool) or a marked exit code (command); stderr:
    a return code or a time-out there; exit_code: that column.
    """
    body, err = F.coalesce(text, F.lit("")), F.coalesce(stderr, F.lit(""))
    mark, failed = error_marker(body), F.coalesce(native, F.lit(False))
    out = lambda primary, name: F.struct(primary.alias("primary"), name.alias("class"))
    yes, no, ok = F.lit(True), F.lit(False), F.lit("ok")
    refused = failed & F.coalesce(mark.isin(*REFUSED), no)
    marked = F.when(refused, out(no, mark)).when(failed, out(yes, F.coalesce(mark, F.lit("unmarked")))).otherwise(out(no, ok))
    head = F.substring(body, 1, 600)
    code = lambda rx: F.coalesce(F.regexp_extract(head, rx, 1).try_cast("int"), F.lit(0)) != 0
    headed = F.when(failed, out(yes, F.lit("native"))).when(native.isNull() & (code(EXIT_HEADER) | code(EXITED)), out(yes, F.lit("exit_header"))).otherwise(out(no, ok))
    plain = F.when(failed, out(yes, F.lit("native"))).otherwise(out(no, ok))
    command = F.coalesce(mark == "gemini_exit_code_nonzero", no)
    level = F.when(failed & command, "tool_failure+command_failure").when(failed, "tool_failure").when(command, "command_failure").otherwise("ok")
    broken = err.rlike(RETURNED) | err.rlike(TIMED_OUT)
    proxy = out(broken, F.when(broken, "proxy").otherwise("ok"))
    coded = F.when(exit_code.isNull(), out(no, F.lit("no_exit_code"))).otherwise(out(exit_code != 0, F.when(exit_code != 0, "exit_nonzero").otherwise("ok")))
    none = out(F.lit(None).cast("boolean"), F.lit("no_definition"))
    by_family = (marked, headed, plain, out(failed | command, level), proxy, coded)
    found = none
    for name, value in reversed(list(zip(FAMILIES, by_family))):
        found = F.when(family == name, value).otherwise(found)
    return found
