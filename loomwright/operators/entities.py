"""Entities of Python sources: classes, functions, calls and imports, from the standard syntax tree.

Parsing is the one step that columns cannot express; it runs over batches of files and returns flat rows, so that all
later steps are joins.
"""

from __future__ import annotations

import ast
import gc
import keyword
import re
import warnings
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

CALL = "struct<type:string,name:string,object:string,attribute:string,full_path:string>"
ENTITY = (
    "module_id string, kind string, id string, name string, class_id string, ordinal int, docstring string, "
    f"bases array<string>, parameters array<struct<name:string,type:string>>, return_type string, calls array<{CALL}>, "
    "first_line int, last_line int, import_module string, import_name string, import_alias string, error string"
)
#: The lines of an entity as text, which ENTITY leaves out: only who names it among the columns has it.
SOURCE = "source string"
#: Modules whose rows are built at once.
ROWS = 512
FIELDS = [x.strip().split()[0] for x in "module_id,kind,id,name,class_id,ordinal,docstring,bases,parameters,return_type,calls,first_line,last_line,import_module,import_name,import_alias,error".split(",")]
#: Columns that rows always have, and the kinds of rows.
ALWAYS, KINDS = ["module_id", "kind", "id", "ordinal"], frozenset(["error", "module", "class", "function", "import", "importfrom"])


def dotted(node: ast.AST) -> str:
    """a.b.c of nested attributes; what is no name at the root is left out."""
    names = []
    while isinstance(node, ast.Attribute):
        names.insert(0, node.attr)
        node = node.value
    return ".".join(([node.id] if isinstance(node, ast.Name) else []) + names)


def type_name(node: ast.AST | None) -> str | None:
    """A plain or dotted name, or Container[Name]; anything else is unknown."""
    if node is None:
        return None
    if isinstance(node, (ast.Name, ast.Attribute)):
        return dotted(node)
    if isinstance(node, ast.Subscript) and isinstance(node.value, (ast.Name, ast.Attribute)):
        return f"{dotted(node.value)}[{dotted(node.slice) if isinstance(node.slice, (ast.Name, ast.Attribute)) else 'unknown'}]"
    return "unknown"


def call_of(node: ast.Call) -> dict | None:
    """The tagged record of a call, null for callees that have no name."""
    out = dict.fromkeys(("type", "name", "object", "attribute", "full_path"))
    match node.func:
        case ast.Name(id=name):
            return out | {"type": "simple", "name": name}
        case ast.Attribute(value=ast.Name(id=owner), attr=attribute):
            return out | {"type": "attribute", "object": owner, "attribute": attribute}
        case ast.Attribute():
            return out | {"type": "nested_attribute", "full_path": dotted(node.func)}
    return None


#: Nodes without children of interest, and what is no node: nothing below them is an entity or a call.
_LEAVES = frozenset([ast.Name, ast.Constant, *(x for k in (ast.expr_context, ast.operator, ast.unaryop, ast.cmpop, ast.boolop) for x in k.__subclasses__()), type(None), str, int, bool])
#: Fields that hold leaves alone whatever the node, and the others of each kind of node.
_PLAIN, _CHILDREN = frozenset(["ctx", "op", "ops", "id", "attr", "kind", "type_comment"]), {}


def _nodes(root: ast.AST) -> list[ast.AST]:
    """The nodes of ``ast.walk`` in its order, without leaves and without statements that are marked as ones without calls."""
    found = [root]
    for node in found:  # grows as it is read
        kind = type(node)
        if (fields := _CHILDREN.get(kind)) is None:
            fields = _CHILDREN[kind] = [f for f in node._fields if f not in _PLAIN]
        for field in fields:
            value = getattr(node, field, None)
            if type(value) is list:
                found += [x for x in value if type(x) not in _LEAVES and not getattr(x, "without_calls", False)]
            elif type(value) not in _LEAVES:
                found.append(value)
    return found


#: Of nodes that hold statements, the fields that do, in their order.  Definitions stand among statements alone.
_BLOCKS = {
    k: fields for k in (ast.Module, *ast.stmt.__subclasses__(), *ast.excepthandler.__subclasses__(), ast.match_case)
    if (fields := tuple(f for f in k._fields if f in ("body", "handlers", "orelse", "finalbody", "cases")))
}


def _definitions(tree: ast.Module) -> list[ast.AST]:
    """Classes and functions at any depth, in the order of ``ast.walk``, without a look at expressions."""
    found = [tree]
    for node in found:  # grows as it is read
        for field in _BLOCKS[type(node)]:
            found += [x for x in getattr(node, field) if type(x) in _BLOCKS]
    return [n for n in found if isinstance(n, (ast.ClassDef, ast.FunctionDef))]


#: What changes how lines become tokens; indents this deep may be too deep for the parser: such modules are parsed whole.
_ODD, _DEEP = ("\t", "\f", "\r", "\0", "\ufeff", "\\\n", "barry_as_FLUFL"), "\n" + " " * 90
#: Lines that open a block of definitions; lines of which positions are read; lines that go on with what stands above them.
_HEADER, _PLACED, _GOES_ON = re.compile(r"(class|def|async def) .*:$"), re.compile(r"(import|from|class|def|async|if|for|while|with|try|match)\b|.*;"), re.compile(r"[)\]}]|(else|elif|except|finally)\b")
#: The longest line that is parsed alone: what the parser finds nested too deep is longer.  Statements of lines, shared by modules.
_SHORT, _MOST, _KNOWN = 160, 4096, {}
#: Names, but for words that the grammar knows: lines that differ in names alone have one shape.
_NAME = re.compile(rf"\b(?!(?:{'|'.join([*keyword.kwlist, *keyword.softkwlist, '__debug__'])})\b)([A-Za-z_]\w*)", re.A)
#: Shapes by what stands between the names; those that the module at hand has taken trees of, and the most trees of one.
_SHAPES, _TAKEN, _TREES = {}, [], 64


class _Shape:
    """Statements of lines that differ in names alone: trees are made once, then a line's names are written into one.  A tree is the
    line's until the next module is parsed."""

    def __init__(self, between: list[str], header: bool):
        self.text = between[0] + "".join(f"n{i}{x}" for i, x in enumerate(between[1:]))
        self.header, self.trees, self.used = header, [], 0

    def made(self) -> tuple[list[ast.stmt], list, list]:
        """Statements, and where single and dotted names stand in them."""
        body, single, dotted = ast.parse(self.text).body, [], []
        if self.header and [type(x) for x in getattr(body[0], "body", ())] != [ast.Pass]:
            raise SyntaxError("no header")
        for node in (y for x in body for y in ast.walk(x)):
            for field, value in ast.iter_fields(node):
                if type(value) is list and any(type(x) is str for x in value):
                    raise SyntaxError("names in a list")
                if type(value) is str:
                    names = [int(x[1:]) if _NAME.fullmatch(x) else x for x in value.split(".")]
                    if len(names) > 1:
                        dotted.append((node, field, names))
                    elif type(names[0]) is int:
                        single.append((node, field, names[0]))
        return body, single, dotted

    def take(self, names: list[str]) -> list[ast.stmt]:
        if self.used == len(self.trees):
            self.trees.append(self.made())
        if not self.used:
            _TAKEN.append(self)
        body, single, dotted = self.trees[self.used]
        self.used += 1
        for node, field, i in single:
            setattr(node, field, names[i])
        for node, field, parts in dotted:
            setattr(node, field, ".".join([names[x] if type(x) is int else x for x in parts]))
        return body


def _shaped(text: str, header: bool = False) -> list[ast.stmt] | None:
    """The statements of a line by its shape; None for the first line of a shape and for lines with texts or lists of names, which have none."""
    if not text.isascii() or '"' in text or "'" in text or "\\" in text or text.startswith(("global ", "nonlocal ")):
        return None
    parts = _NAME.split(text)
    shape = _SHAPES.get(key := (header, *parts[::2]))
    if shape is None:
        if len(_SHAPES) > _MOST:
            _SHAPES.clear()
        _SHAPES[key] = _Shape(parts[::2], header)
    elif shape.used < _TREES:
        return shape.take(parts[1::2])
    return None


class _Pieces:
    """The statements of a module, each parsed alone: plain ones once however often their line occurs, those of a known shape not
    at all, all others in one call.

    One that parses alone leaves no bracket, text or block open, so what follows begins a statement as well.  A SyntaxError
    says that a piece is none, not that the module is wrong."""

    def __init__(self, texts: list[str]):
        self.texts, self.asked, self.places = texts, {}, []
        self.lines = [(i, len(x) - len(t), t.rstrip(" ")) for i, x in enumerate(texts, 1) if (t := x.lstrip(" ")) and t[0] != "#"]

    def ask(self, text: str, key: object) -> int:
        """The place of a line's statements among those that are parsed in one call."""
        if (place := self.asked.get(key)) is None:
            place = self.asked[key] = len(self.places)
            self.places.append(text)
        return place

    def block(self, at: int, indent: int) -> tuple[list, int, int]:
        """Statements from a line on that have its indent, where they end and their last line: lists of nodes, places of plain
        lines, (place, line) of others and (place, line, block, last line) of headers.  Nodes stand for places where they are known."""
        lines, body, n, last = self.lines, [], len(self.lines), 0
        while at < n and lines[at][1] == indent:
            number, _, text = lines[at]
            if (known := _KNOWN.get(text)) is not None and (at + 1 == n or lines[at + 1][1] <= indent):
                body.append(known)
                last, at = number, at + 1
                continue
            end = at + 1
            while end < n and lines[end - 1][2][0] == "@":
                end += 1
            if text.count('"""') % 2:
                while end < n and '"""' not in lines[end][2]:
                    end += 1
                end += 1
            alone = end == at + 1 and len(text) <= _SHORT
            inside = end < n and lines[end][1] > indent
            if alone and inside and _HEADER.match(text):
                text += " pass"
                if (place := _shaped(text, True)) is None:
                    place = self.ask(text, number)
                inner, end, last = self.block(end, lines[end][1])
                body.append((place, number, inner, last))
            elif alone and not inside and not (end < n and _GOES_ON.match(lines[end][2])):
                placed = _PLACED.match(text)
                if (place := self.asked.get(text)) is None and (place := _shaped(text)) is None:
                    place = self.ask(text, number if placed else text)
                body.append((place, number) if placed else place)
                last = number
            else:
                while end < n and (lines[end][1] > indent or lines[end][1] == indent and _GOES_ON.match(lines[end][2])):
                    end += 1
                piece = self.texts[number - 1 : lines[end][0] - 1 if end < n else len(self.texts)]
                if max(map(len, piece)) > _SHORT + indent:
                    raise SyntaxError("long line")
                found = ast.parse("if 1:\n" * (indent > 0) + "\n".join(piece)).body
                found = found[0].body if indent else found
                for x in found:
                    ast.increment_lineno(x, number - 1 - (indent > 0))
                body.append(found)
                last = found[-1].end_lineno
            at = end
        if not body or at < n and lines[at][1] > indent:
            raise SyntaxError("indent")
        return body, at, last

    def tree(self) -> ast.Module:
        for x in _TAKEN:
            x.used = 0
        _TAKEN.clear()
        body, *_ = self.block(0, 0)
        parsed = [[] for _ in self.places]
        for x in ast.parse("\n".join(self.places)).body if self.places else ():
            if x.lineno != x.end_lineno:
                raise SyntaxError("more than a line")
            parsed[x.lineno - 1].append(x)
        if not all(parsed):
            raise SyntaxError("less than a statement")
        if len(_KNOWN) > _MOST:
            _KNOWN.clear()
        for text, place in self.asked.items():
            if type(text) is str:
                _KNOWN[text] = parsed[place]
                if "(" not in text:
                    for x in parsed[place]:
                        x.without_calls = True
        return ast.Module(self._filled(body, parsed), [])

    def _filled(self, body: list, parsed: list[list[ast.stmt]]) -> list[ast.stmt]:
        out = []
        for x in body:
            if type(x) is tuple:
                found = parsed[x[0]] if type(x[0]) is int else x[0]
                if len(x) == 4:
                    (node,) = found
                    if type(x[0]) is int and [type(y) for y in getattr(node, "body", ())] != [ast.Pass]:
                        raise SyntaxError("no header")
                    node.lineno, node.body, node.end_lineno = x[1], self._filled(x[2], parsed), x[3]
                else:
                    for node in found:
                        if type(node) in _BLOCKS:
                            ast.increment_lineno(node, x[1] - node.lineno)
                        else:
                            node.lineno = node.end_lineno = x[1]
                out += found
            else:
                out += parsed[x] if type(x) is int else x
        return out


def syntax_tree(source: str) -> ast.Module:
    """``ast.parse``, but for the positions of plain statements and expressions.  Most of its time goes into nodes, so where many
    lines repeat each is parsed once.  What does not come apart into statements is parsed whole, as are modules with errors."""
    texts = source.split("\n")
    if 3 * len(set(texts)) < 2 * len(texts) and not any(x in source for x in _ODD) and _DEEP not in source and source[-1:] != "\\":
        try:
            return _Pieces(texts).tree()
        except (SyntaxError, ValueError, RecursionError):
            pass
    return ast.parse(source)


def parse(module_id: str, source: str, kinds: frozenset[str] = KINDS, fields: frozenset[str] = frozenset(FIELDS)) -> list[dict]:
    """Rows of one module: itself, then entities in breadth-first order; a file that does not parse is one error row.  Of
    the ``kinds`` and ``fields`` that are not asked for nothing is made; the others are the same whatever is."""
    try:
        tree = syntax_tree(source)
    except (SyntaxError, ValueError, RecursionError) as e:
        return [{"module_id": module_id, "kind": "error", "id": module_id, "ordinal": 0, "error": f"{type(e).__name__}: {e}"}] if "error" in kinds else []
    rows, ordinal = [], 0
    documented, called, texts = "docstring" in fields, "calls" in fields, source.split("\n") if "source" in fields else None
    if "module" in kinds:
        rows.append({"module_id": module_id, "kind": "module", "id": module_id, "name": module_id.rpartition(".")[2], "ordinal": 0, "docstring": ast.get_docstring(tree) or "" if documented else None, "first_line": 1, "last_line": source.count("\n") + 1})

    def add(kind: str, node: ast.AST, name: str, **more) -> None:
        row = {"module_id": module_id, "kind": kind, "id": f"{module_id}.{name}", "name": name, "ordinal": ordinal, "first_line": node.lineno, "last_line": node.end_lineno} | more
        if texts is not None:
            row["source"] = "\n".join(texts[node.lineno - 1 : node.end_lineno])
        rows.append(row)

    defined = _definitions(tree)
    methods = {id(f): c.name for c in defined if isinstance(c, ast.ClassDef) for f in c.body if isinstance(f, ast.FunctionDef)}
    for node in defined:
        ordinal += 1
        if isinstance(node, ast.ClassDef):
            if "class" in kinds:
                add("class", node, node.name, docstring=ast.get_docstring(node) or "" if documented else None, bases=[dotted(b) for b in node.bases if isinstance(b, (ast.Name, ast.Attribute))])
        elif "function" in kinds:
            owner = methods.get(id(node))
            add(
                "function", node, node.name, docstring=ast.get_docstring(node) or "" if documented else None, return_type=type_name(node.returns),
                calls=[c for x in _nodes(node) if isinstance(x, ast.Call) and (c := call_of(x))] if called else None,
                parameters=[{"name": a.arg, "type": type_name(a.annotation)} for a in node.args.args] if "parameters" in fields else None,
                **({"class_id": f"{module_id}.{owner}", "id": f"{module_id}.{owner}.{node.name}"} if owner else {}),
            )
    for node in tree.body:
        for item in node.names if isinstance(node, (ast.Import, ast.ImportFrom)) else []:
            ordinal += 1
            kind = "importfrom" if isinstance(node, ast.ImportFrom) else "import"
            if kind in kinds:
                add(kind, node, item.name, import_module=node.module or "" if kind == "importfrom" else None, import_name=item.name, import_alias=item.asname)
    return rows


def extract(modules: DataFrame, kinds: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Entity rows of modules (module_id, content).  Of equal ids the last one counts; see :func:`latest`.

    A query that reads some ``kinds`` or ``columns`` alone names them: rows have the columns ALWAYS and these, which may be
    ``source``, and what nobody reads is neither made nor moved.

    Syntax trees hold no cycles, so the collector, which would search each of them over and over, rests meanwhile."""
    wanted = [x for x in [*ENTITY.split(", "), SOURCE] if x.split()[0] in [*ALWAYS, *columns]] if columns is not None else [ENTITY]
    kept = ", ".join(wanted)
    schema = to_arrow_schema(StructType.fromDDL(kept))
    asked = () if kinds is None and columns is None else (KINDS if kinds is None else frozenset(kinds), frozenset(schema.names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        collects = gc.isenabled()
        gc.disable()
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                for b in batches:
                    for lo in range(0, b.num_rows, ROWS):
                        part = b.slice(lo, ROWS)
                        rows = [r for m, c in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for r in parse(m, c or "", *asked)]
                        yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)
        finally:
            if collects:
                gc.enable()

    return modules.select("module_id", "content").mapInArrow(run, kept)


def latest(entities: DataFrame, *kinds: str) -> DataFrame:
    """Entities of a kind or several, the last of equal ids of a kind."""
    last = Window.partitionBy(*["kind"][: len(kinds) - 1], "id").orderBy(F.col("ordinal").desc(), F.col("module_id").desc())
    rest = [c for c in entities.columns if c != "id"]
    return entities.filter(F.col("kind").isin(*kinds)).withColumn("_r", F.row_number().over(last)).filter("_r = 1").select("id", *rest)


def imports(entities: DataFrame) -> DataFrame:
    """module_id, pos, type, module, name, alias."""
    return entities.filter(F.col("kind").isin("import", "importfrom")).select("module_id", F.col("ordinal").alias("pos"), F.col("kind").alias("type"), F.col("import_module").alias("module"), F.col("import_name").alias("name"), F.col("import_alias").alias("alias"))


def sources(entities: DataFrame, modules: DataFrame) -> DataFrame:
    """id, source: line ranges of the module texts, as entities have them or, where they do not, by a join."""
    return with_sources(entities.filter(F.col("kind").isin("class", "function")), modules).select("id", "source")


def with_sources(entities: DataFrame, modules: DataFrame | None) -> DataFrame:
    """Classes and functions with their ``source``, which :func:`extract` has added or the module texts give."""
    if "source" in entities.columns:
        return entities
    text = F.array_join(F.slice(F.split("content", "\n"), F.col("first_line"), F.col("last_line") - F.col("first_line") + 1), "\n")
    return entities.join(modules.select("module_id", "content"), "module_id").withColumn("source", text).drop("content")


def outline(source: str, limit: int = 20) -> str:
    """A skeleton: imports, classes with method stubs and the first line of their docs, functions."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        lines = source.split("\n")
        return "\n".join(lines[:limit] + ([f"... ({len(lines) - limit} more lines)"] if len(lines) > limit else []))

    def stub(f: ast.FunctionDef | ast.AsyncFunctionDef, indent: str) -> list[str]:
        doc = (ast.get_docstring(f) or "").split("\n")[0]
        return [f"{indent}def {f.name}({', '.join(a.arg for a in f.args.args)}):", *([f'{indent}    """{doc}"""'] if doc else []), f"{indent}    ..."]

    out = [ast.unparse(n) for n in tree.body if isinstance(n, (ast.Import, ast.ImportFrom))]
    for node in tree.body:
        if isinstance(node, ast.ClassDef):
            out.append(f"class {node.name}{'(' + ', '.join(ast.unparse(b) for b in node.bases) + ')' if node.bases else ''}:")
            body = [line for f in node.body if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)) for line in stub(f, "    ")]
            out += body or ["    ..."]
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out += stub(node, "")
    return "\n".join(out)


def outline_udf():
    """:func:`outline` over batches; an empty text stays empty."""

    @F.pandas_udf("string")
    def each(content: pd.Series) -> pd.Series:
        return content.fillna("").map(lambda x: outline(x) if x else "")

    return each


def outlines(modules: DataFrame) -> DataFrame:
    """module_id, outline."""
    return modules.select("module_id", outline_udf()("content").alias("outline"))
