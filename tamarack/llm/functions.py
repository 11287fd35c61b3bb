"""Functions and procedures of PL/SQL sources, paired with their documentation comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.operators.bounded import spread

# Words that may stand before FUNCTION or PROCEDURE in a header.
_BEFORE = "CREATE OR REPLACE EDITIONABLE NONEDITIONABLE MEMBER STATIC MAP ORDER CONSTRUCTOR FINAL INSTANTIABLE OVERRIDING NOT".split()
# Words that end statements, change the depth or begin a header.
_KEY = "BEGIN END IF LOOP CASE IS AS THEN ELSE DECLARE FUNCTION PROCEDURE PACKAGE TYPE SELF EXISTS".split()
_KEYWORD = rf"(?i:{'|'.join(sorted({*_KEY, *_BEFORE}, key=lambda x: (-len(x), x)))})(?![\p{{L}}\p{{N}}_$#]|\.[\p{{L}}_])"
_WORD = r"[\p{L}_][\p{L}\p{N}_$#]*+(?:\.[\p{L}_][\p{L}\p{N}_$#]*+){0,9}+"
_ITEM = (
    r"(?:[nN]?[qQ]'(?:\[[\s\S]*?\]'|\{[\s\S]*?\}'|\([\s\S]*?\)'|<[\s\S]*?>'|([^\s\[{(<])[\s\S]*?\1')"
    r"|'[^']*(?:'|\z)"
    r'|"[^"]*(?:"|\z)'
    r"|\$\$?[A-Za-z_]+"
    rf"|(?!{_KEYWORD}){_WORD}"
    r"|\((?:[^()'\"/;$-]++|'[^']*+'|-(?!-)|/(?!\*)){0,40}+\)"
    r"|[^\s\p{L}_$'\"();/-]+"
    r"|-(?!-))"
)
#: Tokens, each with the white space behind it: comments, words that decide, runs of up to forty items that decide nothing
#: (strings, names, other words, signs, flat parentheses), and single signs; line ends at the start of a text.
_TOKEN = rf"(?:--[^\n]*|/\*[\s\S]*?(?:\*/|\z)|{_KEYWORD}|{_ITEM}(?:\s*+{_ITEM}){{0,39}}+|[();/-]|\$)\s*+|\n\s*"
#: The name at the start of a run.
_NAME = rf'^(?:"[^"]*"|{_WORD})(?:\.(?:"[^"]*"|[\p{{L}}_][\p{{L}}\p{{N}}_$#]*))*'
# Names of comment entries that describe no function.
_ENTRY = (
    r"@\w+|(?:创建|修改|变更|更新|编写|开发)?\s*(?:作\s*者|人\s*员|人|日\s*期|时\s*间)|创\s*建|修\s*改(?:记录|历史|说明|内容|原因)?|变\s*更(?:记录|历史|说明|内容|原因)?|版\s*本\s*号?|参\s*数(?:说明|列表)?|入\s*参|出\s*参|输入(?:参数)?|输出(?:参数)?|返\s*回\s*值?"
    r"|authors?|owner|created(?: by| on| at| date)?|creation(?: date)?|date|modified(?: by| on| at)?|modification(?:s| date| history)?|changed(?: by| on)?|changes?|change (?:log|history)|history|last (?:change|changed|modified|update)|updated(?: by| on)?"
    r"|version|ver|rev(?:ision)?|param(?:eter)?s?|args?|arguments?|in|out|inputs?|outputs?|returns?|since|copyright"
    r"|autor|fecha|versión|parámetros?|erstellt(?: von| am)?|geändert(?: von| am)?|datum"
)
# Label words before a description.
_LABEL = r"功\s*能\s*描\s*述|功\s*能\s*说\s*明|功\s*能|描\s*述|说\s*明|用\s*途|purpose|description|descr?|summary|function|brief|remarks?|notes?|beschreibung|zweck|funktion|descripción|propósito|función"
# Descriptions that say nothing, without signs and blanks.
_EMPTY_WORDS = (
    "todo tbd tba tbc fixme na none null nil xxx xx x xxxx description desc comment comments placeholder purpose summary empty unknown test temp tmp dummy "
    "seeabove seebelow asabove sameasabove ditto nodescription nocomment notdocumented undocumented tododescribe todoadd todowrite todocomment tododocument tododescription todoadddescription todofill "
    "无 暂无 略 待补充 待补 待定 待完善 待写 未填写 描述 说明 注释 功能描述 功能 同上 见上 见下 空 占位 补充说明 未说明 没有说明 todo描述 todo补充 todo说明 待描述 待说明"
).split()
# Words that add nothing to a repeated name.
_ROUTINE_WORDS = r"the|this|a|an|function|functions|func|fn|procedure|procedures|proc|routine|method|module|body|función|procedimiento|funktion|prozedur"
_ROUTINE_SIGNS = r"函数|存储过程|过程|方法|程序|功能"


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def lexed(files: DataFrame, *, file_id: str, text: str) -> DataFrame:
    """One row for each token that is no line end: file_id, pos, token, comment (or code), line and end_line (from 1).

    What lies between the words and signs that decide about routines is one token, however many
    strings, names and signs it holds, so that a statement is a few rows.

    Tokens of a repeated file lie side by side in its order; one of each is kept.
    """
    texts = spread(files.where(F.col(file_id).isNotNull() & F.col(text).isNotNull()).select(F.col(file_id).alias("file_id"), F.col(text).alias("_text")))
    tokens = texts.select("file_id", F.posexplode(F.regexp_extract_all("_text", F.lit(_TOKEN), F.lit(0))).alias("pos", "raw"))
    order = Window.partitionBy("file_id").orderBy("pos")
    before = F.sum(_newlines(F.col("raw"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    once = tokens.withColumn("last", F.lag("pos").over(order)).where("last is null or last != pos").drop("last")
    return (
        once.withColumn("line", F.lit(1) + F.coalesce(before, F.lit(0)))
        .withColumn("token", F.rtrim("raw", F.lit(" \n\t\r\f\x0b")))
        .withColumn("end_line", F.col("line") + _newlines(F.col("token")))
        .where("token != ''")
        .withColumn("comment", F.col("token").startswith("--") | F.col("token").startswith("/*"))
        .drop("raw")
    )


def routines(files: DataFrame, *, file_id: str, text: str) -> DataFrame:
    """Functions and procedures with a body: file_id, line_start, line_end, routine_name, comment.

    Lexed tokens are rows. Statements are islands between the tokens that end one (;, IS, AS,
    BEGIN and so on outside parentheses); a header is a statement of which FUNCTION or PROCEDURE
    comes first but for words such as CREATE OR REPLACE, and it has a body if it ends with IS or
    AS. Cumulative depth over BEGIN, IF, LOOP, CASE and END puts headers and the ENDs that return
    to their depth in one sequence, of which every header meets its own END. Comments attach to
    the code token that they precede, by windows over the tokens before: those on lines of their
    own above the first token of the header's statement.

    line_start is the line of FUNCTION or PROCEDURE, line_end that of the closing END (null if
    there is none), comment the comment tokens joined by line ends (null if there is none), the
    name in lower case without schema. Null and empty texts and null ids give no row. All windows
    are by file: a task holds the tokens of one source text at a time.
    """
    order = Window.partitionBy("file_id").orderBy("pos")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    code = ~F.col("comment")
    t = lexed(files, file_id=file_id, text=text).withColumn("up", F.when(code & F.col("token").rlike(rf"^(?:{_KEYWORD}|[;(/)])$"), F.upper("token")))
    # Comments on lines of their own, by the code token that they precede.
    t = (
        t.withColumn("group", F.coalesce(F.sum(code.cast("int")).over(before), F.lit(0)))
        .withColumn("code_above", F.last(F.when(code, F.col("end_line")), ignorenulls=True).over(before))
    )
    # A group is a code token and the comments before it.
    group = Window.partitionBy("file_id", "group")
    t = t.withColumn("code_below", F.max(F.when(code, F.col("line"))).over(group))
    own = F.col("comment") & (F.coalesce("code_above", F.lit(0)) < F.col("line")) & (F.coalesce("code_below", F.col("end_line") + 1) > F.col("end_line"))
    t = t.withColumn("above", F.collect_list(F.when(own, F.struct("pos", "token"))).over(group)).where(code)
    t = t.withColumn("above", F.transform(F.sort_array("above"), lambda x: x["token"])).drop("comment", "group").withColumn("code_next", F.lead("line").over(order))
    # Statements.
    t = t.withColumn("prev", F.lag("up").over(order)).withColumn("part", F.coalesce(F.sum((F.col("up") == ";").cast("int")).over(before), F.lit(0)))
    paren = F.when(F.col("up") == "(", 1).when(F.col("up") == ")", -1).otherwise(0)
    t = t.withColumn("paren", F.sum(paren).over(Window.partitionBy("file_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    alone = (F.col("up") == "/") & (F.coalesce("code_above", F.lit(0)) < F.col("line")) & (F.coalesce("code_next", F.col("line") + 1) > F.col("line"))
    ends = (F.col("up") == ";") | alone | ((F.col("paren") <= 0) & F.col("up").isin("IS", "AS", "BEGIN", "THEN", "ELSE", "LOOP", "DECLARE") & ~F.coalesce((F.col("up") == "AS") & (F.col("prev") == "SELF"), F.lit(False)))
    t = t.withColumn("ends", F.coalesce(ends, F.lit(False)))
    starts = F.coalesce(F.lag("ends").over(order), F.lit(True)) | F.coalesce(F.col("up") == "CREATE", F.lit(False))
    t = t.withColumn("statement", F.sum(starts.cast("int")).over(upto)).withColumn("unit", F.sum(F.coalesce(F.col("up") == "CREATE", F.lit(False)).cast("int")).over(upto))
    inside = Window.partitionBy("file_id", "statement").orderBy("pos")
    others = F.sum((~F.coalesce(F.col("up").isin(_BEFORE), F.lit(False))).cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    named = F.when(F.col("up").isNull() & F.col("token").rlike(r'^[\p{L}_"]'), F.struct("pos", F.regexp_extract("token", _NAME, 0).alias("token")))
    whole_statement = Window.partitionBy("file_id", "statement")
    t = (
        t.withColumn("header", F.col("up").isin("FUNCTION", "PROCEDURE") & (F.coalesce(others, F.lit(0)) == 0))
        .withColumn("unit_header", F.col("up").isin("PACKAGE", "TYPE") & (F.coalesce(others, F.lit(0)) == 0))
        .withColumn("at", F.min(F.when(F.col("header"), F.col("pos"))).over(whole_statement))
        .withColumn("name", F.min(F.when(F.col("pos") > F.col("at"), named)).over(whole_statement)["token"])
        .withColumn("doc", F.first("above").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    )
    whole = inside.rowsBetween(Window.unboundedPreceding, 0)
    head = F.last(F.when(F.col("header"), F.struct("line", "name", "doc")), ignorenulls=True).over(whole)
    is_unit = F.max(F.coalesce(F.col("unit_header"), F.lit(False))).over(whole)
    body = F.col("ends") & F.col("up").isin("IS", "AS")
    opener = F.coalesce((F.col("up") == "BEGIN") | (F.col("up").isin("IF", "LOOP", "CASE") & (F.coalesce("prev", F.lit("")) != "END")) | (body & F.col("is_unit")), F.lit(False))
    closer = F.coalesce((F.col("up") == "END") & ~F.col("token").contains("."), F.lit(False))
    t = t.withColumn("head", head).withColumn("is_unit", is_unit).where("up is not null").withColumn("step", opener.cast("int") - closer.cast("int"))
    per_unit = Window.partitionBy("file_id", "unit").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("depth", F.sum("step").over(per_unit))
    # Headers with a body and the ENDs that return to their depth, in one sequence for each depth.
    t = t.withColumn("event", F.when(body & F.col("head").isNotNull(), 1).when(F.col("step") < 0, -1)).where("event is not null")
    level = Window.partitionBy("file_id", "unit", "depth").orderBy("pos")
    t = t.withColumn("open", F.sum("event").over(level.rowsBetween(Window.unboundedPreceding, 0)))
    pair = Window.partitionBy("file_id", "unit", "depth", F.expr("if(event = 1, open - 1, open)")).orderBy("pos")
    t = t.withColumn("line_end", F.lead("end_line").over(pair)).where("event = 1")
    name = F.lower(F.regexp_replace(F.regexp_extract("head.name", r'("[^"]*"|[^."]+)$', 1), '"', ""))
    return t.select("file_id", F.col("head.line").cast("int").alias("line_start"), F.col("line_end").cast("int").alias("line_end"), name.alias("routine_name"), F.when(F.size("head.doc") > 0, F.array_join("head.doc", "\n")).alias("comment"))


def description(comment: Column) -> Column:
    """What a comment says, without its signs, rule lines, entries on author, change, version and parameters, and label words."""
    plain = F.regexp_replace(comment, r"\r", "")
    plain = F.regexp_replace(plain, r"(?m)^[ \t]*(?:/\*+|--+)|\*+/[ \t]*$", "")
    lines = F.transform(F.split(plain, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^[\s*#=~_-]+|[\s*#=~_-]+$", "")))
    entry = rf"(?iu)^(?:@\w+\b|(?:created|modified|changed|updated|written|last changed|last modified) (?:by|on|at)\b|[【\[]?(?:{_ENTRY})[】\]]?\s*(?:[:：]|[】\]]))"
    lines = F.filter(lines, lambda x: x.rlike(r"[\p{L}\p{N}]") & ~x.rlike(entry))
    label = rf"(?iu)^[【\[]?(?:{_LABEL})\s*(?:[】\]]\s*[:：]?|[:：]|$)\s*"
    return F.trim(F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, label, "")), " "))


def _words(text: Column) -> Column:
    """The words of a text in lower case, with single blanks between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def says_something(text: Column, name: Column) -> Column:
    """Whether a description is more than nothing, a placeholder or the routine's name."""
    return _say_something(_words(text), name)


def _say_something(words: Column, name: Column) -> Column:
    tight = F.replace(words, F.lit(" "), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(words, rf"\b(?:{_ROUTINE_WORDS})\b", " "), _ROUTINE_SIGNS, " ")
    bare = F.replace(bare, F.lit(" "), F.lit(""))
    short = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "")
    return F.coalesce((tight != "") & ~tight.isin(_EMPTY_WORDS) & (bare != "") & (bare != short) & (tight != short), F.lit(False))


def documented_functions(files: DataFrame, *, file_id: str, text: str, code: bool = False) -> DataFrame:
    """Routines whose comment says something: file_id, line_start, line_end, routine_name, description and, if asked, code.

    code is the source from line_start to line_end (null where no END was found). Repeated files
    with the same id count once.
    """
    found = routines(files, file_id=file_id, text=text)
    # Exploded, so that the description and its words are worked out once and not again for each use of them.
    found = found.select("*", F.explode(F.array(description(F.col("comment")))).alias("description")).drop("comment")
    found = found.select("*", F.explode(F.array(_words(F.col("description")))).alias("_words"))
    found = found.where(_say_something(F.col("_words"), F.col("routine_name"))).drop("_words")
    if code:
        texts = files.groupBy(F.col(file_id).alias("file_id")).agg(F.first(text).alias("_text"))
        part = F.array_join(F.expr("slice(split(_text, '\n'), line_start, line_end - line_start + 1)"), "\n")
        found = found.join(texts, "file_id").withColumn("code", F.when(F.col("line_end") >= F.col("line_start"), part)).drop("_text")
    return found
