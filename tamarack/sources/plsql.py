"""Facts from PL/SQL source texts: packages, routines, parameters, tables, columns, views, triggers, sequences, names used."""

from __future__ import annotations

import bisect
import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.operators.bounded import spread
from tamarack.operators.relational import BizError

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have the package

_TOKEN = re.compile(
    r"(?P<skip>--[^\n]*|/\*.*?(?:\*/|\Z)|\s+)|(?P<text>[nN]?[qQ]'(?:\[.*?\]'|\{.*?\}'|\(.*?\)'|<.*?>'|([^\s\[{(<]).*?\3')|'[^']*(?:'|\Z))|(?P<name>\"[^\"]*\"|\$\$?\w+|[^\W\d][\w$#]*)|(?P<sign>:=|=>|\.\.|<<|>>|\|\||\d+(?:\.\d+)?|.)",
    re.S,
)
#: Columns of a fact: what it is, where it belongs, and its details.
SCHEMA = "file_id long, fact string, package string, unit string, name string, type string, mode string, pos int, detail string, line_start int, line_end int"
_OPEN = {"BEGIN", "IF", "LOOP", "CASE"}


class _Reader:
    """Reads the facts of one source text."""

    def __init__(self, text: str) -> None:
        ends = [i for i, c in enumerate(text) if c == "\n"]
        self.toks: list[str] = []
        self.raw: list[str] = []
        self.lines: list[int] = []
        for m in _TOKEN.finditer(text):
            if m.lastgroup == "skip" or m["skip"] is not None:
                continue
            self.raw.append(m[0])
            self.toks.append("''" if m["text"] is not None else m[0].strip('"').upper() if m["name"] is not None else m[0])
            self.lines.append(bisect.bisect_left(ends, m.start()) + 1)
        self.facts: list[tuple] = []

    def tok(self, i: int) -> str:
        return self.toks[i] if i < len(self.toks) else ""

    def line(self, i: int) -> int:
        return self.lines[min(i, len(self.lines) - 1)] if self.lines else 1

    def add(self, fact: str, package: str | None, unit: str | None, name: str, **more: object) -> None:
        self.facts.append((fact, package, unit, name, more.get("type"), more.get("mode"), more.get("pos"), more.get("detail"), more.get("line_start"), more.get("line_end")))

    def dotted(self, i: int) -> tuple[str, int]:
        """A name with dots from i on, and the place behind it."""
        parts = [self.tok(i)]
        i += 1
        while self.tok(i) == "." and re.match(r"\w", self.tok(i + 1) or "-"):
            parts.append(self.tok(i + 1))
            i += 2
        return ".".join(parts), i

    def until(self, i: int, *stops: str) -> int:
        """The next of ``stops`` outside parentheses."""
        depth = 0
        while i < len(self.toks):
            x = self.toks[i]
            if depth <= 0 and x in stops:
                return i
            depth += (x == "(") - (x == ")")
            i += 1
        return i

    def words(self, i: int, j: int) -> str:
        return re.sub(r"\s*([.,()%])\s*", r"\1", " ".join(self.raw[i:j]))

    def read(self) -> list[tuple]:
        i = 0
        while i < len(self.toks):
            if self.toks[i] != "CREATE":
                i += 1
                continue
            start = i
            i += 1
            while self.tok(i) in {"OR", "REPLACE", "EDITIONABLE", "NONEDITIONABLE", "GLOBAL", "TEMPORARY", "FORCE", "NO", "MATERIALIZED", "UNIQUE", "PUBLIC"}:
                i += 1
            kind = self.tok(i)
            read = getattr(self, f"_{kind.lower()}", None) if kind in {"PACKAGE", "FUNCTION", "PROCEDURE", "TABLE", "VIEW", "SEQUENCE", "TRIGGER"} else None
            i = read(i, start) if read else i + 1
        return self.facts

    def _package(self, i: int, start: int) -> int:
        body = self.tok(i + 1) == "BODY"
        name, i = self.dotted(i + 1 + body)
        package = name.rsplit(".", 1)[-1]
        i = self.until(i, "IS", "AS", ";") + 1
        while i < len(self.toks) and self.tok(i) not in {"END", "BEGIN", "CREATE"}:
            x = self.tok(i)
            if x in {"FUNCTION", "PROCEDURE"}:
                i = self.routine(i, package, None, body)
                continue
            end = self.until(i, ";")
            if x in {"TYPE", "SUBTYPE"}:
                self.add("type", package, None, self.tok(i + 1), line_start=self.line(i))
            elif x not in {"PRAGMA", "CURSOR", ";"} and re.match(r"\w", x):
                constant = self.tok(i + 1) == "CONSTANT"
                value = next((k for k in range(i, end) if self.tok(k) in {":=", "DEFAULT"}), end)
                self.add("constant" if constant else "variable", package, None, x, type=self.words(i + 1 + constant, value), detail=self.words(value + 1, end) or None, line_start=self.line(i))
            i = end + 1
        if self.tok(i) == "BEGIN":
            i = self.block(i, package, "__INIT__")
        end = self.until(i, ";")
        self.add("package_body" if body else "package_spec", package, None, package, line_start=self.line(start), line_end=self.line(end))
        return end + 1

    def _function(self, i: int, start: int) -> int:
        name, _ = self.dotted(i + 1)
        return self.routine(i, f"__STANDALONE_{name.rsplit('.', 1)[-1]}__", None, True)

    _procedure = _function

    def routine(self, i: int, package: str, outer: str | None, body: bool) -> int:
        """A routine's header and, if it has one, its body; a local routine counts as part of the outer one."""
        start, kind = i, self.tok(i)
        name, i = self.dotted(i + 1)
        name = name.rsplit(".", 1)[-1]
        unit = outer or f"{name}@{self.line(start)}"
        if self.tok(i) == "(":
            pos, at, end = 0, i + 1, self.until(i + 1, ")")
            while at < end:
                stop = min(self.until(at, ","), end)
                self.parameter(package, unit, at, stop, pos := pos + 1, outer)
                at = stop + 1
            i = end + 1
        kinds = self.until(i, "IS", "AS", ";")
        returns = self.words(i + 1, next((k for k in range(i, kinds) if self.tok(k) in {"DETERMINISTIC", "PIPELINED", "PARALLEL_ENABLE", "RESULT_CACHE"}), kinds)) if self.tok(i) == "RETURN" else None
        if self.tok(kinds) in {"IS", "AS"}:
            end = self.body(kinds + 1, package, unit)
        else:
            end = kinds
        if not outer:
            has_body = self.tok(kinds) in {"IS", "AS"}
            self.add("routine", package, unit, name, type=kind, mode="BODY" if has_body else "SPEC", detail=returns, line_start=self.line(start), line_end=self.line(end))
        return end + 1

    def parameter(self, package: str, unit: str, i: int, end: int, pos: int, outer: str | None) -> None:
        name, k, modes = self.tok(i), i + 1, []
        while self.tok(k) in {"IN", "OUT", "NOCOPY"}:
            modes += [self.tok(k)] * (self.tok(k) != "NOCOPY")
            k += 1
        default = next((j for j in range(k, end) if self.tok(j) in {":=", "DEFAULT"}), end)
        if not outer:
            self.add("parameter", package, unit, name, type=self.words(k, default), mode=" ".join(modes) or "IN", pos=pos, detail=self.words(default + 1, end) or None, line_start=self.line(i))

    def body(self, i: int, package: str, unit: str) -> int:
        """From behind IS to the ; that ends the routine; names used are facts of the outermost routine."""
        first = True
        while i < len(self.toks) and self.tok(i) != "BEGIN":
            if first and self.tok(i) in {"FUNCTION", "PROCEDURE"}:
                i = self.routine(i, package, unit, True)
                continue
            if first and self.tok(i) in {"LANGUAGE", "EXTERNAL"}:
                return self.until(i, ";")
            first = self.tok(i) == ";"
            i = self.use(i, package, unit)
        return self.until(self.block(i, package, unit), ";")

    def block(self, i: int, package: str, unit: str) -> int:
        depth = 0
        while i < len(self.toks):
            x = self.tok(i)
            if x in _OPEN and self.tok(i - 1) != "END":
                depth += 1
            elif x == "END":
                depth -= 1
                if not depth:
                    return i + 1
            i = self.use(i, package, unit)
        return i

    def use(self, i: int, package: str, unit: str) -> int:
        if not re.match(r"[^\W\d]", self.tok(i)) or self.tok(i - 1) in {".", "%", ":"}:
            return i + 1
        name, end = self.dotted(i)
        self.add("use", package, unit, name, mode="CALL" if self.tok(end) in {"(", ";"} else "NAME", line_start=self.line(i))
        return end

    def _table(self, i: int, start: int) -> int:
        name, i = self.dotted(i + 1)
        table = name.rsplit(".", 1)[-1]
        at = self.until(i, "(", ";", "AS")
        if self.tok(at) != "(":
            return at
        end = self.until(at + 1, ")")
        self.add("table", None, None, table, line_start=self.line(start), line_end=self.line(end))
        k, pos, keys = at + 1, 0, []
        while k < end:
            stop = min(self.until(k, ","), end)
            words = self.toks[k:stop]
            if words[:1] and words[0] in {"CONSTRAINT", "PRIMARY", "FOREIGN", "UNIQUE", "CHECK"}:
                if "PRIMARY" in words and "(" in words:
                    at_key = words.index("(", words.index("PRIMARY"))
                    keys += [w for w in words[at_key + 1 : words.index(")", at_key)] if w != ","]
            elif words:
                rest = next((j for j in range(k + 1, stop) if self.tok(j) in {"NOT", "NULL", "DEFAULT", "PRIMARY", "UNIQUE", "CONSTRAINT", "CHECK", "REFERENCES", "GENERATED"}), stop)
                default = next((self.words(j + 1, next((m for m in range(j + 1, stop) if self.tok(m) in {"NOT", "PRIMARY", "UNIQUE", "CONSTRAINT", "CHECK"}), stop)) for j in range(k, stop) if self.tok(j) == "DEFAULT"), None)
                if "PRIMARY" in words:
                    keys.append(words[0])
                self.add("column", None, table, words[0], type=self.words(k + 1, rest), mode="NOT NULL" if "NOT NULL" in " ".join(words) else "NULL", pos=(pos := pos + 1), detail=default, line_start=self.line(k))
            k = stop + 1
        for key in keys:
            self.add("key", None, table, key)
        return end + 1

    def _view(self, i: int, start: int) -> int:
        name, i = self.dotted(i + 1)
        end = self.until(i, ";")
        self.add("view", None, None, name.rsplit(".", 1)[-1], line_start=self.line(start), line_end=self.line(end))
        for k in range(i, end):
            if self.tok(k) in {"FROM", "JOIN"} and re.match(r"\w", self.tok(k + 1) or "-"):
                self.add("view_source", None, name.rsplit(".", 1)[-1], self.dotted(k + 1)[0])
        return end + 1

    def _sequence(self, i: int, start: int) -> int:
        name, i = self.dotted(i + 1)
        self.add("sequence", None, None, name.rsplit(".", 1)[-1], line_start=self.line(start))
        return self.until(i, ";") + 1

    def _trigger(self, i: int, start: int) -> int:
        name, i = self.dotted(i + 1)
        on = self.until(i, "ON")
        head = self.toks[i:on]
        timing = "COMPOUND" if "COMPOUND" in self.toks[on : on + 12] and "FOR" in head[:1] else "INSTEAD OF" if "INSTEAD" in head else next((x for x in head if x in {"BEFORE", "AFTER"}), "FOR")
        target, k = self.dotted(on + 1)
        stop = self.until(k, "BEGIN", "DECLARE", "COMPOUND")
        header = self.toks[k:stop]
        condition = None
        if "WHEN" in header:
            at = k + header.index("WHEN")
            condition = self.words(at + 2, self.until(at + 2, ")"))
        events = ",".join(dict.fromkeys(x for x in head if x in {"INSERT", "UPDATE", "DELETE"}))
        begin = self.until(stop, "BEGIN")
        end = self.block(begin, None, name.rsplit(".", 1)[-1]) if self.tok(stop) != "COMPOUND" else self.compound(stop)
        self.add("trigger", None, target.rsplit(".", 1)[-1], name.rsplit(".", 1)[-1], type=timing, mode="ROW" if "EACH" in header else "STATEMENT", detail=f"{events}|{condition or ''}", line_start=self.line(start), line_end=self.line(end))
        return end

    def compound(self, i: int) -> int:
        """Behind a compound trigger: its sections each end with END ... ;, the last END stands alone."""
        while i < len(self.toks):
            if self.tok(i) == "BEGIN":
                i = self.until(self.block(i, None, "__TRIGGER__"), ";")
            elif self.tok(i) == "END":
                return self.until(i, ";")
            i += 1
        return i


def read_facts(text: str | None) -> list[tuple]:
    """The facts of one text; none of a null or empty one."""
    return _Reader(text).read() if text else []


def facts(files: DataFrame, *, file_id: str, text: str) -> DataFrame:
    """All facts of all files, in the columns of SCHEMA; one pass in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            rows = [(i, *f) for i, x in zip(batch["file_id"], batch["text"], strict=True) if isinstance(x, str) for f in read_facts(x)]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"pos": "Int32", "line_start": "Int32", "line_end": "Int32"})

    return spread(files.select(F.col(file_id).cast("long").alias("file_id"), F.col(text).alias("text"))).mapInPandas(run, SCHEMA)


def packages(found: DataFrame) -> DataFrame:
    """package, spec_file and body_file, paired by name over all trees; of several files the smallest id."""
    pick = lambda fact: F.min(F.when(F.col("fact") == fact, F.col("file_id")))
    return found.where("fact in ('package_spec', 'package_body')").groupBy("package").agg(pick("package_spec").alias("spec_file"), pick("package_body").alias("body_file"))


def calls(found: DataFrame) -> DataFrame:
    """file_id, package, unit, callee_package and callee: names used in a routine that are routines of its package, of a named package, or standalone.

    A routine's call of itself is dropped; local names that aren't known routines join nothing.
    """
    known = found.where("fact = 'routine'").select(F.col("package").alias("callee_package"), F.col("name").alias("callee")).distinct()
    used = found.where("fact = 'use'").select("file_id", "package", "unit", F.upper("name").alias("name")).distinct()
    used = used.withColumn("parts", F.split("name", r"\."))
    local = F.when(F.size("parts") == 1, F.array(F.col("package"), F.concat(F.lit("__STANDALONE_"), F.col("name"), F.lit("__")))).otherwise(F.array(F.element_at("parts", -2)))
    asked = used.select("file_id", "package", "unit", F.explode(local).alias("callee_package"), F.element_at("parts", -1).alias("callee"))
    found_calls = asked.join(known, ["callee_package", "callee"]).where(~((F.col("callee_package") == F.col("package")) & (F.col("callee") == F.substring_index("unit", "@", 1))))
    return found_calls.select("file_id", "package", "unit", "callee_package", "callee").distinct()


def package_refs(found: DataFrame) -> DataFrame:
    """file_id, package, unit, ref_package and name: names of known packages that are no routines, split at the last dot."""
    units = found.where("fact in ('package_spec', 'package_body')").select(F.col("package").alias("ref_package")).distinct()
    known = found.where("fact = 'routine'").select(F.col("package").alias("ref_package"), "name").distinct()
    used = found.where("fact = 'use' and instr(name, '.') > 0").select("file_id", "package", "unit", F.upper("name").alias("full")).distinct()
    split = used.select("file_id", "package", "unit", F.regexp_extract("full", r"([^.]+)\.[^.]+$", 1).alias("ref_package"), F.substring_index("full", ".", -1).alias("name"))
    return split.join(units, "ref_package").join(known, ["ref_package", "name"], "left_anti").where("ref_package != package").select("file_id", "package", "unit", "ref_package", "name").distinct()


def package_dependencies(found: DataFrame) -> DataFrame:
    """package, depends_on and how ('call', 'ref' or 'both'): packages that call routines of another or use its constants, types or variables."""
    called = calls(found).select("package", F.col("callee_package").alias("depends_on"), F.lit(1).alias("c"), F.lit(0).alias("r"))
    referred = package_refs(found).select("package", F.col("ref_package").alias("depends_on"), F.lit(0).alias("c"), F.lit(1).alias("r"))
    both = called.unionByName(referred).where("package != depends_on").groupBy("package", "depends_on").agg(F.max("c").alias("c"), F.max("r").alias("r"))
    return both.select("package", "depends_on", F.when(F.col("c") + F.col("r") == 2, "both").when(F.col("c") == 1, "call").otherwise("ref").alias("how"))


def tables(found: DataFrame) -> DataFrame:
    """table, pos, column, type, nullable, default_value and is_key of every column of CREATE TABLE."""
    keys = found.where("fact = 'key'").select("file_id", "unit", "name").distinct().withColumn("is_key", F.lit(True))
    columns = found.where("fact = 'column'").select("file_id", "unit", "name", "pos", "type", "mode", "detail")
    return columns.join(keys, ["file_id", "unit", "name"], "left").select(
        F.col("unit").alias("table"), "pos", F.col("name").alias("column"), "type", (F.col("mode") == "NULL").alias("nullable"), F.col("detail").alias("default_value"), F.coalesce("is_key", F.lit(False)).alias("is_key")
    )


def triggers(found: DataFrame) -> DataFrame:
    """trigger, table, timing, level, events (an array) and condition of every CREATE TRIGGER."""
    parts = F.split("detail", r"\|", 2)
    return found.where("fact = 'trigger'").select(
        F.col("name").alias("trigger"), F.col("unit").alias("table"), F.col("type").alias("timing"), F.col("mode").alias("level"), F.split(parts[0], ",").alias("events"), F.nullif(parts[1], F.lit("")).alias("condition")
    )


def resolve_entry(found: DataFrame, entry: str) -> tuple[str, str, int]:
    """Package, routine and number of the overload that an entry point names, among the routines with a body.

    A name that no routine has raises NO_ENTRY, one that several share without a number, or that
    packages of several folders have, AMBIGUOUS_ENTRY. Reads the routines of one name only.
    """
    wanted = parse_entry(entry)
    same = found.where("fact = 'routine' and mode = 'BODY'").where((F.upper("package") == wanted["package"]) & (F.upper("name") == wanted["name"].upper()))
    rows = same.select("file_id", "line_start", "unit").distinct().orderBy("file_id", "line_start", "unit").take(1000)
    if not rows or wanted["overload"] and not 1 <= int(wanted["overload"]) <= len(rows):
        raise BizError("NO_ENTRY", f"no routine {entry}")
    if len(rows) > 1 and not wanted["overload"]:
        raise BizError("AMBIGUOUS_ENTRY", f"{len(rows)} routines {entry}: name one by __1 to __{len(rows)}")
    return wanted["package"], wanted["name"].upper(), int(wanted["overload"] or 1)


def slices(files: DataFrame, ranges: DataFrame, *, file_id: str, text: str, first: str, last: str) -> DataFrame:
    """Lines ``first`` to ``last`` of each file's text for the rows of ``ranges``: its columns and source; an invalid range gives null."""
    texts = files.select(file_id, F.split(text, "\n").alias("_lines"))
    part = F.array_join(F.slice("_lines", F.col(first), F.col(last) - F.col(first) + 1), "\n")
    ok = (F.col(first) >= 1) & (F.col(last) >= F.col(first)) & (F.col(last) <= F.size("_lines"))
    return ranges.join(texts, file_id).withColumn("source", F.when(ok, part)).drop("_lines")


def parse_entry(entry: str) -> dict[str, str | None]:
    """[folder/]PACKAGE.name[__n] as folder, package (upper case), name and overload number; other texts raise ValueError."""
    found = re.fullmatch(r"(?:(?P<folder>.+)/)?(?P<package>[^./\s]+)\.(?P<name>[^./\s]+?)(?:__(?P<n>\d+))?", entry.strip())
    if not found:
        raise ValueError(f"not an entry point: {entry}")
    return {"folder": found["folder"], "package": found["package"].upper(), "name": found["name"], "overload": found["n"]}
