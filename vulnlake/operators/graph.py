"""Code graphs: nodes of parsed Python texts, edges and features as joins and windows."""

from __future__ import annotations

import ast
import gc
import keyword
import re
from functools import partial
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NODE_TYPES = {
    "file_id": pa.int64(), "node_id": pa.int32(), "node_type": pa.string(), "value": pa.string(), "start_line": pa.int32(),
    "end_line": pa.int32(), "start_col": pa.int32(), "end_col": pa.int32(), "parent_id": pa.int32(), "parent_type": pa.string(),
    "field": pa.string(), "field_no": pa.int32(), "depth": pa.int32(), "num_children": pa.int32(), "is_definition": pa.bool_(),
}
_SQL_NAMES = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.bool_(): "boolean"}

#: What the edges and features read; a step that needs no more has no other columns built and sent.
CONTROL_COLUMNS = ("file_id", "node_id", "node_type", "parent_id", "parent_type", "field", "field_no")
FEATURE_COLUMNS = ("file_id", "node_id", "node_type", "value", "start_line", "end_line", "depth", "num_children")
NAMED = ("Name", "arg")
DATAFLOW_COLUMNS = ("file_id", "node_id", "node_type", "value", "parent_type", "field", "is_definition")

BATCH_NODES = 8192
GC_THRESHOLD = (200_000, 20, 100)

# Kinds of nodes by their role.
CONTROL = ("If", "While", "For", "AsyncFor", "IfExp", "Match", "Try")
LOOPS = ("While", "For", "AsyncFor")
JUMPS = ("Return", "Break", "Continue")
CATEGORIES = (
    ("control", CONTROL),
    ("assignment", ("Assign", "AugAssign", "AnnAssign")),
    ("identifier", ("Name", "arg")),
    ("call", ("Call",)),
    ("function", ("FunctionDef", "AsyncFunctionDef", "Lambda")),
    ("class", ("ClassDef",)),
    ("operator", ("BinOp", "BoolOp", "UnaryOp", "Compare")),
    ("literal", ("Constant", "JoinedStr")),
    ("import", ("Import", "ImportFrom")),
)


def _value(node, value_chars):
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.arg):
        return node.arg
    if isinstance(node, ast.Constant) and not isinstance(node.value, bool) and node.value is not None:
        return str(node.value)[:value_chars]
    if isinstance(node, (ast.FunctionDef, ast.ClassDef)):
        return node.name
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
        return node.func.id
    return None


class Error(ast.stmt):
    """A line that no statement can be read from; its names are its children."""

    _fields = ("names",)


PARSE_ERRORS = (SyntaxError, ValueError, RecursionError, MemoryError)
MOST_NESTED, MOST_PADDED = 50, 200
# Words that are no names in Python or JavaScript, and those that go on with the statement before.
WORDS = frozenset(keyword.kwlist) | frozenset(
    "const let var function new typeof instanceof void delete this super export default case switch do catch throw extends static null undefined "
    "true false interface enum implements private public protected readonly abstract declare namespace of debugger".split())
CLAUSES = ("else", "elif", "except", "finally")
_LINES = re.compile(r"\r\n|\r|\n")
_SPANS = re.compile(r'''"{3}(?:[^\\]|\\.)*?"{3}|\'{3}(?:[^\\]|\\.)*?\'{3}|"(?:[^"\\\r\n]|\\.)*"|\'(?:[^\'\\\r\n]|\\.)*\'|`(?:[^`\\]|\\.)*`|/\*.*?\*/|//[^\r\n]*|\#[^\r\n]*|[(\[{]|[)\]}]''', re.S)
_NAMES = re.compile(
    r'''"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'|\#.*|//.*|\d\w*|(?P<dot>\.\s*)?(?P<name>[^\W\d][\w$]*|\$[\w$]*)'''
    r"(?:(?P<assigned>\s*(?::\s*[\w.<>\[\]]+\s*)?=(?![=>]))|(?P<changed>\s*(?:\*\*|//|>>>?|<<|&&|\|\||\?\?|[-+*/%&|^@])=))?")


def _error(line: str, number: int) -> list[ast.stmt]:
    """The names of a line in their order: what is assigned is a definition, what follows a dot or stands in a text or comment is no name."""
    at = {"lineno": number, "end_lineno": number}
    names, begin, seen = [], 0, 0
    for found in _NAMES.finditer(line):
        name = found["name"]
        if name is None or found["dot"] or name in WORDS:
            continue
        begin += len(line[seen:found.start("name")].encode(errors="replace"))
        seen = found.start("name")
        place = at | {"col_offset": begin, "end_col_offset": begin + len(name.encode(errors="replace"))}
        defined = found["assigned"] or found["changed"]
        node = ast.Name(id=name, ctx=ast.Store() if defined else ast.Load(), **place)
        names.append(ast.AugAssign(target=node, **place) if found["changed"] else node)
    return [Error(names=names, col_offset=0, end_col_offset=len(line.encode(errors="replace")), **at)] if names else []


def _blanked(span) -> str:
    """JavaScript's block comments and templates as blanks, but for the expressions of a template."""
    if span[0][:2] != "/*" and span[0][0] != "`":
        return span[0]
    kept = [False] * len(span[0])
    for inner in re.finditer(r"\$\{([^{}]*)\}", span[0]) if span[0][0] == "`" else ():
        kept[inner.start(1):inner.end(1)] = [True] * len(inner[1])
    return "".join(c if keep or c in "\r\n" else " " for c, keep in zip(span[0], kept))


def _units(text: str) -> list[tuple[int, int, list[str]]]:
    """(indentation, number of the first line, lines) of the logical lines of a text: open brackets and long texts go on over lines."""
    if "`" in text or "/*" in text:
        text = _SPANS.sub(_blanked, text)
    lines = _LINES.split(text)
    starts, ends = [0], []
    for end in _LINES.finditer(text):
        starts.append(end.end())
        ends.append(end.start())
    joined, line, opened = set(), 0, []  # line numbers that go on with the line before
    for span in _SPANS.finditer(text):
        while line + 1 < len(starts) and starts[line + 1] <= span.start():
            line += 1
        token = span[0]
        if token in "([{":
            opened.append(line)
        elif token in ")]}":
            if opened:
                joined.update(range(opened.pop() + 1, line + 1))
        elif token[:3] in ('"""', "'''") and len(token) >= 6:
            joined.update(range(line + 1, line + 1 + len(_LINES.findall(token))))
    units = []
    for number, content in enumerate(lines):
        if units and (number in joined or lines[number - 1].endswith("\\")):
            units[-1][2].append(content)
        elif content.strip():
            units.append((len(content) - len(content.lstrip()), number + 1, [content]))
    return units


def _statements(lines: list[str], number: int, indented: bool) -> list[ast.stmt] | None:
    """Statements of lines at their places, if they parse."""
    above = min(number - 1, MOST_PADDED) - indented  # empty lines cost less than a walk over the nodes, if they are few
    try:
        tree = ast.parse("\n" * above + "\n".join(["if 1:", *lines] if indented else lines))
    except PARSE_ERRORS:
        return None
    body = tree.body[0].body if indented and tree.body else tree.body
    if number - 1 - indented != max(above, 0):
        for node in body:
            ast.increment_lineno(node, number - 1 - indented - max(above, 0))
    return body


def _read(units: list) -> list[ast.stmt] | None:
    """Statements of a whole block, if it parses."""
    lines = []
    for _, number, more in units:
        lines += [""] * (number - units[0][1] - len(lines)) + more  # empty lines are in no unit
    return _statements(lines, units[0][1], units[0][0] > 0)


def _recovered(units: list, nested: int = 0) -> list[ast.stmt]:
    """Statements of the logical lines, block by block; a block that does not parse is its head and the statements below it."""
    body, i = [], 0
    while i < len(units):
        indent, number, first = units[i]
        cuts, j = [i], i + 1
        while j < len(units):
            word = units[j][2][0].lstrip()
            if units[j][0] <= indent:
                if units[j][0] < indent or not (word.startswith(CLAUSES) or units[cuts[-1]][2][0].lstrip().startswith("@")):
                    break
                cuts.append(j)
            j += 1
        found = _read(units[i:j])
        if found is None:
            found = []
            for a, b in zip(cuts, [*cuts[1:], j]):
                found += (_read(units[a:b]) if len(cuts) > 1 else None) or _headed(units[a], units[a + 1:b], nested, b > a + 1)
        body += found
        i = j
    return body


def _headed(head: tuple, below: list, nested: int, may_parse: bool) -> list[ast.stmt]:
    """The statement that a line begins, with the statements below it as its body; else its names, and those statements after them."""
    indent, number, lines = head
    under = _recovered(below, nested + 1) if below and nested < MOST_NESTED else [
        node for _, at, more in below for k, line in enumerate(more) for node in _error(line, at + k)]
    begun = _statements(lines, number, indent > 0) if may_parse else None
    if begun is None and lines[-1].split("#")[0].rstrip().endswith(":"):
        begun = _statements([*lines, " " * (indent + 1) + "pass"], number, indent > 0)
        if begun:
            begun[-1].body = under
            return begun
    if begun is None:
        if len(lines) > 1:  # brackets that do not belong together
            begun = _recovered([(len(x) - len(x.lstrip()), number + k, [x]) for k, x in enumerate(lines) if x.strip()], nested + 1) if nested < MOST_NESTED else [
                node for k, x in enumerate(lines) for node in _error(x, number + k)]
        else:
            begun = _error(lines[0], number)
    return begun + under


def _tree(text: str, recover: bool):
    """The syntax tree of a text; of one that does not parse nothing, or what can be read of it."""
    try:
        return ast.parse(text)
    except PARSE_ERRORS:
        return ast.Module(body=_recovered(_units(text)), type_ignores=[]) if recover else None


# What a kind of node says of all its nodes: name, fields, whether it has a place, may have a value, is an argument.
_VALUED = (ast.Name, ast.arg, ast.Constant, ast.FunctionDef, ast.ClassDef, ast.Call)
_KINDS = {kind: (kind.__name__, kind._fields, bool(kind._attributes), issubclass(kind, _VALUED), issubclass(kind, ast.arg))
          for kind in [*vars(ast).values(), Error] if isinstance(kind, type) and issubclass(kind, ast.AST) and (kind is ast.Constant or not issubclass(kind, ast.Constant))}


def _nodes_of(file_id, text, value_chars, recover=False):
    """Node rows of one text in pre-order; nothing for a text that does not parse, unless it is to be recovered."""
    root = _tree(text, recover)
    if root is None:
        return
    stack = [(root, None, None, None, 0, 0)]
    pop = stack.pop
    number = 0
    while stack:
        node, parent, parent_type, field, place, depth = pop()
        kind, fields, placed, valued, stores = _KINDS[node.__class__]
        if not fields and not placed:  # contexts and operators: no children, value or place
            yield (file_id, number, kind, None, 0, 0, 0, 0, parent, parent_type, field, place, depth, 0, False)
            number += 1
            continue
        children = []
        below = depth + 1
        for name in fields:
            part = getattr(node, name, None)
            if part.__class__ is list:
                children += [(child, number, kind, name, i, below) for i, child in enumerate(part) if child.__class__ in _KINDS]
            elif part.__class__ in _KINDS:
                children.append((part, number, kind, name, 0, below))
                stores = stores or part.__class__ is ast.Store
        if placed:
            line, column = node.lineno, node.col_offset
            end_line, end_column = node.end_lineno or line, node.end_col_offset or column
        else:
            line = column = end_line = end_column = 0
        yield (file_id, number, kind, _value(node, value_chars) if valued else None, line, end_line, column, end_column,
               parent, parent_type, field, place, depth, len(children), stores)
        children.reverse()
        stack += children
        number += 1


def _node_batches(batches, value_chars, columns=tuple(NODE_TYPES), recover=False, kinds=None):
    usual = gc.get_threshold()
    gc.set_threshold(*GC_THRESHOLD)  # trees hold no cycles; looking for some after every few hundred nodes takes a tenth of the time
    try:
        for batch in batches:
            texts = zip(batch.column("file_id").to_pylist(), batch.column("text").to_pylist())
            rows = (row for file_id, text in texts for row in _nodes_of(file_id, text or "", value_chars, recover) if kinds is None or row[2] in kinds)
            while part := list(islice(rows, BATCH_NODES)):
                values = dict(zip(NODE_TYPES, zip(*part)))
                yield pa.RecordBatch.from_arrays([pa.array(values[name], NODE_TYPES[name]) for name in columns], names=list(columns))
    finally:
        gc.set_threshold(*usual)


def parse_nodes(files: DataFrame, value_chars: int | None = None, columns: tuple[str, ...] = tuple(NODE_TYPES), recover: bool = False,
                kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(file_id, text) to node rows. Texts are independent, so any partitioning will do.

    Constants are kept whole unless ``value_chars`` cuts them. A task holds the tree of one text and a few thousand node rows. A text
    that does not parse has no rows; with ``recover`` it has the statements that can be read on their own, in their blocks, and for
    every other line, of whatever language, a node `Error` over its names. Only nodes of the given ``kinds`` are sent, if there are some."""
    schema = ", ".join(f"{name} {_SQL_NAMES[NODE_TYPES[name]]}" for name in columns)
    return files.select("file_id", "text").mapInArrow(partial(_node_batches, value_chars=value_chars, columns=columns, recover=recover, kinds=kinds), schema)


def _edges(frame: DataFrame, source, target, kind: str) -> DataFrame:
    return frame.select("file_id", source.alias("source"), target.alias("target"), F.lit(kind).alias("kind"))


def tree_edges(nodes: DataFrame) -> DataFrame:
    """Parent to child and back: two rows per child from one pass."""
    pair = F.array(F.struct(F.col("parent_id").alias("source"), F.col("node_id").alias("target")),
                   F.struct(F.col("node_id").alias("source"), F.col("parent_id").alias("target")))
    return (nodes.filter(F.col("parent_id").isNotNull()).select("file_id", F.inline(pair))
            .withColumn("kind", F.lit("ast")))


def sequence_edges(nodes: DataFrame) -> DataFrame:
    """Each node to the next one by start line."""
    order = Window.partitionBy("file_id").orderBy("start_line", "node_id")
    return _edges(nodes.withColumn("_next", F.lead("node_id").over(order)).filter(F.col("_next").isNotNull()),
                  F.col("node_id"), F.col("_next"), "control")


def dataflow_edges(nodes: DataFrame, last_only: bool = False) -> DataFrame:
    """Definition to use of the same name: from all earlier definitions, or the last one only. What `x += 1` names is both."""
    names = nodes.filter(F.col("node_type").isin(*NAMED) & F.col("value").isNotNull())
    changed = F.coalesce((F.col("parent_type") == "AugAssign") & (F.col("field") == "target"), F.lit(False))
    used = ~F.col("is_definition") | changed
    uses = names.filter(used).select("file_id", "value", F.col("node_id").alias("use_id"))
    if last_only:
        before = Window.partitionBy("file_id", "value").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
        last = F.last(F.when(F.col("is_definition"), F.col("node_id")), ignorenulls=True).over(before)
        found = names.withColumn("_def", last).filter(used & F.col("_def").isNotNull())
        return _edges(found, F.col("_def"), F.col("node_id"), "dataflow")
    defs = names.filter("is_definition").select("file_id", "value", F.col("node_id").alias("def_id"))
    return _edges(uses.join(defs, ["file_id", "value"]).filter(F.col("def_id") < F.col("use_id")),
                  F.col("def_id"), F.col("use_id"), "dataflow")


def control_edges(nodes: DataFrame) -> DataFrame:
    """Edges of conditions, loops, calls and jumps, from parent and child roles.

    A node row tells its parent's type and its own role, and the condition of an ``If`` is
    the first node below it, so every edge follows from one row: no join, no shuffle. Node 0
    takes part like any other.
    """
    kind, parent, role = F.col("node_type"), F.col("parent_type"), F.col("field")
    up, here = F.col("parent_id"), F.col("node_id")
    first = F.col("field_no") == 0

    def edge(test, source, target):
        return F.when(test, F.struct(source.alias("source"), target.alias("target")))

    loop_body = parent.isin(*LOOPS) & (role == "body") & first
    edges = F.array(
        edge(kind.isin(*CONTROL[:4], "Call", *JUMPS), up, here),
        edge((parent == "If") & (role == "test"), up, here),
        edge((parent == "If") & role.isin("body", "orelse") & first, up + 1, here),
        edge(loop_body, up, here), edge(loop_body, here, up),
        edge((parent == "Call") & (role == "func"), up, here))
    return (nodes.filter(up.isNotNull()).select("file_id", F.inline(F.array_distinct(F.array_compact(edges))))
            .withColumn("kind", F.lit("control")))


def node_features(nodes: DataFrame) -> DataFrame:
    """Category flags, text shape, number of children and line span per node."""
    category = F.lit("other")
    for name, kinds in reversed(CATEGORIES):
        category = F.when(F.col("node_type").isin(*kinds), name).otherwise(category)
    text = F.coalesce("value", F.lit(""))
    flags = [(F.col("category") == n).cast("double").alias(f"is_{n}") for n in [c for c, _ in CATEGORIES] + ["other"]]
    return nodes.withColumn("category", category).select(
        "file_id", "node_id", "category", *flags,
        F.least(F.char_length(text) / 100.0, F.lit(1.0)).alias("text_length"),
        (text.contains("$") | text.contains("*")).cast("double").alias("has_special"),
        text.rlike(r"(?U)^[^\W\d]\w*$").cast("double").alias("is_name"),
        text.rlike(r"\d").cast("double").alias("has_digit"),
        ((F.upper(text) == text) & (F.lower(text) != text)).cast("double").alias("is_upper"),
        F.col("value").isNotNull().cast("double").alias("has_value"), "depth", "num_children",
        F.when(F.col("start_line") > 0, F.col("end_line") - F.col("start_line") + 1).otherwise(1).alias("line_span"))


def leaf_tokens(nodes: DataFrame) -> DataFrame:
    """(file_id, tokens): type of every node and text of every leaf, depth first.

    A text's nodes come from one row, so its token list fits where the text did.
    """
    token = F.when((F.col("num_children") == 0) & F.col("value").isNotNull(),
                   F.array("node_type", "value")).otherwise(F.array("node_type"))
    return nodes.groupBy("file_id").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("node_id", token.alias("t")))), lambda s: s["t"])).alias("tokens"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean nodes and edges per text and the share of each edge kind."""
    per_file = nodes.groupBy("file_id").agg(F.count("*").alias("nodes"))
    per_edges = edges.groupBy("file_id").agg(
        F.count("*").alias("edges"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("ast", "control", "dataflow")])
    joined = per_file.join(per_edges, "file_id", "left").na.fill(0)
    total = F.sum("edges")
    return joined.agg(
        F.count("*").alias("samples"), F.avg("nodes").alias("avg_nodes"), F.avg("edges").alias("avg_edges"),
        *[F.when(total > 0, F.sum(k) / total).otherwise(0.0).alias(f"{k}_share") for k in ("ast", "control", "dataflow")])
