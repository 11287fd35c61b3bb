"""Reports of checkers, test runs and coverage tools as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.operators.nested import xml_table


def _mapped(key: Column, pairs: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for k, v in pairs.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def checkstyle(reports: DataFrame, xml: str) -> DataFrame:
    """Findings of checkstyle reports: file, line, rule, severity, category and message beside the report's other columns.

    The rule is the check's class without package and 'Check'; errors are major, warnings minor,
    all else info. Checks of names are 'naming-convention', others 'code-format'.
    """
    fields = {"file": ("string", "../@name"), "line": ("int", "@line"), "_severity": ("string", "@severity"), "_source": ("string", "@source"), "message": ("string", "@message")}
    x = xml_table(reports, xml, "/checkstyle/file/error", fields)
    rule = F.regexp_replace(F.regexp_extract("_source", r"([^.]*)$", 1), "Check$", "")
    category = F.when(F.col("_source").contains(".naming."), "naming-convention").otherwise("code-format")
    return x.withColumns({"tool": F.lit("checkstyle"), "rule": rule, "severity": _mapped(F.col("_severity"), {"error": "major", "warning": "minor"}, "info"), "category": category}).drop("_severity", "_source")


def pmd(reports: DataFrame, xml: str) -> DataFrame:
    """Findings of PMD reports, as of ``checkstyle``: priorities 1 and 2 are major, 3 minor, lower ones info."""
    fields = {"file": ("string", "../@name"), "line": ("int", "@beginline"), "_priority": ("string", "@priority"), "rule": ("string", "@rule"), "message": ("string", ".")}
    x = xml_table(reports, xml, "/pmd/file/violation", fields)
    category = F.when(F.col("rule").isin("EmptyCatchBlock", "CloseResource"), "collection-exception").otherwise("code-format")
    return x.withColumns({"tool": F.lit("pmd"), "message": F.trim("message"), "severity": _mapped(F.col("_priority"), {"1": "major", "2": "major", "3": "minor"}, "info"), "category": category}).drop("_priority")


def cpd(reports: DataFrame, xml: str) -> DataFrame:
    """Places of duplicated code: lines and tokens of the duplication, path and start line of each place."""
    fields = {"lines": ("int", "../@lines"), "tokens": ("int", "../@tokens"), "path": ("string", "@path"), "start_line": ("int", "@line")}
    return xml_table(reports, xml, "/pmd-cpd/duplication/file", fields)


def jacoco(reports: DataFrame, xml: str) -> DataFrame:
    """Lines of coverage reports: line, missed and covered instructions and branches; a line is covered if an instruction of it is."""
    fields = {"source_file": ("string", "../@name"), "line": ("int", "@nr"), "missed": ("int", "@mi"), "covered": ("int", "@ci"), "missed_branches": ("int", "@mb"), "covered_branches": ("int", "@cb")}
    return xml_table(reports, xml, "/report/package/sourcefile/line", fields).withColumn("is_covered", F.col("covered") > 0)


def coverage(lines: DataFrame, *keys: str) -> DataFrame:
    """line_rate and branch_rate by ``keys`` of the lines of ``jacoco``: covered over missed and covered; null where there is nothing to cover."""
    rate = lambda part, whole: F.try_divide(part.cast("double"), whole)
    hit, branches = F.count(F.when(F.col("is_covered"), 1)), F.sum("covered_branches")
    return lines.groupBy(*keys).agg(rate(hit, F.count("line")).alias("line_rate"), rate(branches, F.sum("covered_branches") + F.sum("missed_branches")).alias("branch_rate"))


def build_logs(logs: DataFrame, text: str) -> DataFrame:
    """compiled (BUILD SUCCESS and no BUILD FAILURE), tests, failures, errors, skipped and passed beside the log's other columns.

    The counts of all 'Tests run: ...' lines are summed, the totals that follow a 'Results' line
    aside; a null log has nothing compiled and no tests.
    """
    pattern = r"Tests run: (\d+), Failures: (\d+), Errors: (\d+), Skipped: (\d+)"
    runs = F.substring_index(F.coalesce(text, F.lit("")), "Results", 1)
    count = lambda n: F.aggregate(F.regexp_extract_all(runs, F.lit(pattern), F.lit(n)), F.lit(0), lambda a, x: a + x.cast("int"))
    log = F.coalesce(F.col(text), F.lit(""))
    out = logs.withColumns({"compiled": log.contains("BUILD SUCCESS") & ~log.contains("BUILD FAILURE"), "tests": count(1), "failures": count(2), "errors": count(3), "skipped": count(4)})
    return out.withColumn("passed", F.col("tests") - F.col("failures") - F.col("errors") - F.col("skipped")).drop(text)


def gates(summary: DataFrame, key: str) -> DataFrame:
    """key, gate and passed of the gates that numbers decide; where there is nothing to judge a gate is passed.

    ``summary`` has one row a unit with completed, total, methods, score, all_passed, must_fix,
    compiled, passed_tests and total_tests. G1: 80 percent completed. G2: at least as many
    methods as completed units. G3: a score of 70. G4: nothing to fix where all passed. G5:
    compiled. G6: 70 percent of the tests passed.
    """
    least = lambda part, whole, share: F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)) >= share, F.lit(True))
    rules = {
        "G1": least("completed", "total", 0.8), "G2": F.coalesce(F.col("methods") >= F.col("completed"), F.lit(True)), "G3": F.coalesce(F.col("score") >= 70, F.lit(True)),
        "G4": ~F.coalesce(F.col("all_passed"), F.lit(False)) | (F.coalesce("must_fix", F.lit(0)) == 0), "G5": F.coalesce(F.col("compiled"), F.lit(True)), "G6": least("passed_tests", "total_tests", 0.7),
    }
    rows = F.array(*[F.struct(F.lit(g).alias("gate"), rule.alias("passed")) for g, rule in rules.items()])
    return summary.select(key, F.inline(rows))
