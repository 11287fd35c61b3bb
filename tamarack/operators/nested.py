"""JSON_TABLE, XMLTABLE, JSON and XML functions, object types."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _steps(path: str) -> list[str]:
    """The field names of a path such as '$.a.b[*]'; the last step of rows has [*]."""
    return [x for x in path.removeprefix("$").replace("[*]", "").split(".") if x]


def _ddl(steps: Sequence[str], leaf: str) -> str:
    """The type of a document that holds ``leaf`` below ``steps``."""
    for step in reversed(steps):
        leaf = f"struct<`{step}`: {leaf}>"
    return leaf


def json_table(
    df: DataFrame,
    column: str,
    schema: str,
    *,
    path: str = "$",
    ordinality: str | None = None,
    nested: tuple[str, str] | None = None,
    nested_ordinality: str | None = None,
    defaults: dict[str, object] | None = None,
    on_error: str = "empty",
) -> DataFrame:
    """JSON_TABLE(column, path COLUMNS (...)): the fields of ``schema`` as columns beside the row's own.

    ``path`` '$' reads an object, '$[*]' one row for each element of an array, '$.a.b[*]' of an
    array in a field; ``ordinality`` numbers elements from 1. ``nested`` is NESTED PATH: a path
    below the row and its fields, joined from the left (a row without elements stays, its fields
    null). ``defaults`` are values ON EMPTY. The document is parsed once.

    Rows whose JSON is null or without elements give no row. Broken JSON gives none either, or
    raises with ``on_error`` 'error'. Fields of another type are null. Of columns with the name
    of ``column`` nothing is left.
    """
    others = [c for c in df.columns if c != column]
    fields = T.StructType.fromDDL(schema)
    row = fields
    if nested:
        inner = T.StructType.fromDDL(nested[1])
        steps = _steps(nested[0])
        row = T.StructType([*fields.fields, *T._parse_datatype_string(_ddl(steps, f"array<{inner.simpleString()}>")).fields])
    many = path.endswith("[*]")
    steps = _steps(path)
    kind = f"array<{row.simpleString()}>" if many else row.simpleString()
    text = F.col(column) if steps or not many else F.concat(F.lit('{"_rows":'), F.col(column), F.lit("}"))
    steps = steps or (["_rows"] if many else [])
    top = T._parse_datatype_string(_ddl(steps, kind))
    bad = "_broken"
    parsed = F.from_json(text, T.StructType([*top.fields, T.StructField(bad, T.StringType())]), {"columnNameOfCorruptRecord": bad})
    rows = df.select(*others, F.col(column).alias("_text"), parsed.alias("_j")).where("_j is not null")
    broken = F.col("_j")[bad].isNotNull() & F.try_parse_json("_text").isNull()
    if on_error == "error":
        rows = rows.withColumn("_j", F.when(broken, F.raise_error(F.concat(F.lit("broken JSON: "), "_text"))).otherwise(F.col("_j")))
    else:
        rows = rows.where(~broken)
    for step in steps:
        rows = rows.withColumn("_j", F.col("_j")[step])
    number = []
    if many:
        rows = rows.select(*others, F.posexplode("_j").alias("_i", "_j"))
        number = [(F.col("_i") + 1).alias(ordinality)] if ordinality else []
    below = []
    if nested:
        kids = F.col("_j")
        for step in _steps(nested[0]):
            kids = kids[step]
        rows = rows.withColumn("_kids", kids)
        rows = rows.select(*[c for c in rows.columns if c != "_kids"], F.posexplode_outer("_kids").alias("_n", "_k"))
        below = [(F.col("_n") + 1).alias(nested_ordinality)] if nested_ordinality else []
        below += [F.col("_k")[f.name].alias(f.name) for f in inner.fields]
    given = defaults or {}
    own = [(F.coalesce(F.col("_j")[f.name], F.lit(given[f.name])) if f.name in given else F.col("_j")[f.name]).alias(f.name) for f in fields.fields]
    return rows.select(*others, *number, *own, *below)


def xml_table(df: DataFrame, column: str, row_path: str, fields: dict[str, tuple[str, str]], *, ordinality: str | None = None) -> DataFrame:
    """XMLTABLE(row_path PASSING column COLUMNS name type PATH path): one row for each node of ``row_path``.

    ``fields`` names for each column its type and its path below the node: 'a/b', '@attribute',
    'a/@attribute', '.' for the node's own text or '../@attribute' for its parent's. A missing child is null in its own row, of
    repeated children the first counts, a value of another type is null. The document is parsed
    once. Null or broken XML gives no row.
    """
    keep = [c for c in df.columns if c != column]
    steps = [x for x in row_path.split("/") if x]
    tree: dict = {}
    above = {"_" + path.removeprefix("../@"): {} for _, path in fields.values() if path.startswith("../@")}
    for _, path in fields.values():
        if path.startswith("../"):
            continue
        at = tree
        for part in [x for x in path.split("/") if x not in {"", "."}]:
            at = at.setdefault("_" + part[1:] if part.startswith("@") else part, {})
        if path in {"", "."}:
            tree.setdefault("_VALUE", {})
    kind = _xml_type(tree)
    for n, step in enumerate(reversed(steps[1:])):
        attributes = "".join(f"`{k}`: string, " for k in above) if n == 0 else ""
        kind = f"struct<{attributes}`{step}`: array<{kind}>>"
    options = {"rowTag": steps[0], "valueTag": "_VALUE", "attributePrefix": "_", "mode": "PERMISSIVE"}
    nodes = F.array(F.from_xml(F.col(column), kind, options))
    for step in steps[1:]:
        below = F.transform(F.filter(nodes, lambda x: x.isNotNull()), _children(step, list(above) if step is steps[-1] else []))
        nodes = F.flatten(F.filter(below, lambda x: x.isNotNull()))
    rows = df.where(F.col(column).isNotNull()).select(*keep, F.posexplode(nodes).alias("_i", "_x"))
    rows = rows.where("_x.x is not null" if above else "_x is not null")
    node, up = (F.col("_x")["x"], F.col("_x")) if above else (F.col("_x"), F.col("_x"))
    value = lambda path: up["_" + path.removeprefix("../@")] if path.startswith("../") else _xml_value(node, path)
    number = [(F.col("_i") + 1).alias(ordinality)] if ordinality else []
    return rows.select(*keep, *number, *[value(path).try_cast(kind).alias(n) for n, (kind, path) in fields.items()])


def _children(step: str, above: Sequence[str]) -> Callable[[Column], Column]:
    """The children ``step`` of a node, each beside the node's attributes ``above`` if any are asked for; null where there is none."""

    def of(node: Column) -> Column:
        return F.transform(node[step], lambda x: F.struct(x.alias("x"), *[node[k].alias(k) for k in above])) if above else node[step]

    return of


def _xml_type(tree: dict) -> str:
    """The type of a node: attributes and own text are strings, children arrays, so that one or many can be there."""
    parts = [f"`{k}`: " + (_xml_type(v) if k.startswith("_") else f"array<{_xml_type(v)}>") for k, v in tree.items()]
    return f"struct<{', '.join(parts)}>" if parts else "string"


def _xml_value(node: Column, path: str) -> Column:
    for part in [x for x in path.split("/") if x not in {"", "."}]:
        node = node["_" + part[1:]] if part.startswith("@") else F.get(node[part], F.lit(0))
    return node["_VALUE"] if path in {"", "."} else node


def xml_forest(**children: Column) -> Column:
    """XMLFOREST: an element for each child that is not null."""
    return F.concat_ws("", *[F.when(v.isNotNull(), xml_element(k, v)) for k, v in children.items()])


def xml_root(body: Column, version: str = "1.0") -> Column:
    """XMLROOT: ``body`` behind an XML declaration."""
    return F.concat(F.lit(f'<?xml version="{version}"?>'), body)


def xml_pi(name: str, text: Column) -> Column:
    """XMLPI: a processing instruction."""
    return F.concat(F.lit(f"<?{name} "), text.cast("string"), F.lit("?>"))


def xml_element(name: str, value: Column, **attributes: Column) -> Column:
    """XMLELEMENT(name, XMLATTRIBUTES(...), value), with special signs escaped; a null value gives an empty element."""
    escape = lambda x: F.replace(F.replace(F.replace(x.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    head = [F.lit(f"<{name}")]
    for k, v in attributes.items():
        head += [F.when(v.isNotNull(), F.concat(F.lit(f' {k}="'), F.replace(escape(v), F.lit('"'), F.lit("&quot;")), F.lit('"')))]
    return F.concat_ws("", *head, F.lit(">"), escape(value), F.lit(f"</{name}>"))


def volume_cm3(dim: Column) -> Column:
    """The product of an item's length, width and height; missing ones count as 0."""
    part = lambda f: F.coalesce(dim[f], F.lit(0).cast("decimal(10,2)"))
    return part("length_cm") * part("width_cm") * part("height_cm")


def volumetric_weight_kg(dim: Column) -> Column:
    """Volume over 5000, rounded to three digits."""
    return F.round(volume_cm3(dim) / F.lit(5000), 3)


def chargeable_weight_kg(dim: Column) -> Column:
    """The larger of weight (missing: 0) and volumetric weight."""
    return F.greatest(F.coalesce(dim["weight_kg"], F.lit(0).cast("decimal(10,3)")), volumetric_weight_kg(dim))
