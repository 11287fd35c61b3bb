"""START WITH ... CONNECT BY: a query block run by the operator, level by level, without limits of recursion."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tamarack.dialect.tokens import close, ends, find, primary, split, text, up
from tamarack.operators.connect_by import connect_by

_STOP = {"GROUP", "HAVING", "ORDER", "START", "CONNECT", "FETCH", "OFFSET"}
_VIEWS = itertools.count()


def is_hierarchy(toks: list[str]) -> bool:
    """Whether a block walks a hierarchy, not just counts levels."""
    c = find(toks, "CONNECT")
    return c >= 0 and any(x.upper() == "PRIOR" for x in toks)


def run_block(toks: list[str], spark: SparkSession, translate: Callable[[list[str]], str]) -> list[str]:
    """The block over a view of its walked rows: SELECT ... FROM view WHERE ... ORDER BY ...

    Rows of FROM are the edges; START WITH picks the roots. One PRIOR equality links them; other
    conditions of CONNECT BY filter the edges, LEVEL <= n ends the walk. WHERE filters
    afterwards. LEVEL, CONNECT_BY_ROOT, SYS_CONNECT_BY_PATH, PRIOR, CONNECT_BY_ISLEAF and
    CONNECT_BY_ISCYCLE may be selected; ORDER SIBLINGS BY sorts ascending. Without NOCYCLE a
    cycle raises. Rows with a null key are no ancestors and no roots.
    """
    f, w, s, c = find(toks, "FROM"), find(toks, "WHERE"), find(toks, "START"), find(toks, "CONNECT")
    source = toks[f + 1 : ends(toks, f + 1, {"WHERE", *_STOP})]
    if len(split(source)) > 1:
        raise NotImplementedError("CONNECT BY over a comma join: join in FROM with ON")
    rows = spark.sql(f"SELECT * FROM {translate(source)}")
    columns = {x.upper() for x in rows.columns}
    if len(columns) < len(rows.columns):
        raise NotImplementedError("CONNECT BY over tables that share column names")
    cond = toks[c + 2 : ends(toks, c + 2, _STOP)]
    nocycle = up(cond, 0) == "NOCYCLE"
    link, filters, stop = None, [], None
    for part in split(cond[nocycle:], "AND"):
        words = [x.upper() for x in part]
        if words[0] == "LEVEL" and len(part) == 3 and part[1] in {"<=", "<"} and part[2].isdigit():
            stop = int(part[2]) - (part[1] == "<")
        elif "PRIOR" not in words:
            filters.append(part)
        elif link is None and "=" in part and words.count("PRIOR") == 1 and words.index("PRIOR") in {0, part.index("=") + 1}:
            link = part
        else:
            raise NotImplementedError("CONNECT BY with more than one PRIOR condition: use tamarack.operators.connect_by.connect_by")
    at = link.index("=")
    left, right = link[:at], link[at + 1 :]
    key, parent = (left[1:], right) if up(left, 0) == "PRIOR" else (right[1:], left)

    def plain(x: list[str], row: str) -> str:
        """Translated text of an expression whose columns are fields of ``row``."""
        out, i = [], 0
        while i < len(x):
            if i + 2 < len(x) and x[i + 1] == "." and x[i + 2].strip("`").upper() in columns:
                i += 2
            out += [row, ".", x[i]] if x[i].strip("`").upper() in columns and up(x, i + 1) != "(" else [x[i]]
            i += 1
        return translate(out)

    edges = rows.select(F.struct(*[F.col(f"`{x}`") for x in rows.columns]).alias("_row"))
    edges = edges.withColumns({"_key": F.expr(plain(key, "_row")), "_parent": F.expr(plain(parent, "_row"))})
    start = edges.where(F.expr(plain(toks[s + 2 : ends(toks, s + 2, _STOP)], "_row"))) if s >= 0 else edges
    for part in filters:
        edges = edges.where(F.expr(plain(part, "_row")))
    kind = rows.schema.simpleString()
    carry = {"_row": (F.col("_row"), F.col("_row")), "_top": (F.col("_row"), F.col("up__top")), "_prior": (F.lit(None).cast(kind), F.col("up__row"))}
    select, out, i = toks[1:f], [], 0

    def carried(first: str, later: str) -> str:
        name = f"_c{len(carry)}"
        carry[name] = (F.expr(first), F.expr(later))
        return name

    def ends_at(i: int) -> int:
        end = primary(select, i)
        if end == i:
            raise NotImplementedError(f"{select[i - 1]} of an expression")
        return end

    while i < len(select):
        word = up(select, i)
        if word == "SYS_CONNECT_BY_PATH":
            end = close(select, i + 1)
            x, sep = split(select[i + 2 : end - 1])
            shown = f"coalesce(cast({plain(x, '_row')} as string), '')"
            out.append(carried(f"concat({text(sep)}, {shown})", f"concat(`up__c{len(carry)}`, {text(sep)}, {shown})"))
            i = end
        elif word in {"CONNECT_BY_ROOT", "PRIOR"}:
            end = ends_at(i + 1)
            out += plain(select[i + 1 : end], "_top" if word == "CONNECT_BY_ROOT" else "_prior").split(" ")
            i = end
        elif word in {"CONNECT_BY_ISLEAF", "CONNECT_BY_ISCYCLE"}:
            out.append("is_leaf" if word == "CONNECT_BY_ISLEAF" else "is_cycle")
            i += 1
        elif word == "LEVEL":
            out.append("level")
            i += 1
        elif i + 2 < len(select) and select[i + 1] == "." and select[i + 2].strip("`").upper() in columns | {"*"}:
            i += 2
        else:
            out.append(select[i])
            i += 1
    tail = toks[max(ends(toks, c + 2, _STOP), ends(toks, s + 2, _STOP) if s >= 0 else 0) :]
    siblings = up(tail, 0) == "ORDER" and up(tail, 1) == "SIBLINGS"
    if siblings:
        end = ends(tail, 3, {"FETCH", "OFFSET"})
        items = split(tail[3:end])
        if any(up(x, len(x) - 1) == "DESC" for x in items):
            raise NotImplementedError("ORDER SIBLINGS BY descending")
        items = [x[:-1] if up(x, len(x) - 1) == "ASC" else x for x in items]
        mine = "array(struct(" + ", ".join(f"{plain(x, '_row')} IS NULL, {plain(x, '_row')}" for x in items) + ", _key))"
        order = carried(mine, f"concat(`up__c{len(carry)}`, {mine})")
        tail = ["ORDER", "BY", order, *tail[end:]]
    carry["_key0"] = (F.col("_key"), F.col("_key"))
    walked = connect_by(edges, start, parent="_parent", child="_key", root="_key", nocycle=nocycle, stop_level=stop, max_level=10_000, carry=carry)
    extra = [x for x in walked.columns if x not in {"_row", "root", "item", "path"} and x.upper() not in columns]
    view = f"_tamarack_walk{next(_VIEWS)}"
    walked.select("_row.*", *extra).createOrReplaceTempView(view)
    where = toks[w : ends(toks, w + 1, _STOP)] if w >= 0 else []
    alias = [source[-1]] if len(source) > 1 and source[-2].upper() not in {".", ")"} and "JOIN" not in {x.upper() for x in source} else []
    if len(source) == 1:
        alias = [source[0]]
    return ["SELECT", *out, "FROM", view, *alias, *where, *tail]
