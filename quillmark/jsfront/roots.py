"""Functions and classes of a program: which are visited, how complex they are, and their digests."""

from __future__ import annotations

import sys
from bisect import bisect_right
from dataclasses import dataclass, field

from quillmark.jsfront.normalize import Stream
from quillmark.jsfront.parser import Node, parse
from quillmark.jsfront.scope import Scopes

DEFAULT_MIN = 3
_NONE = ("Ident", "Binding", "Name", "PrivateName", "ThisExpression", "Super", "BooleanLiteral", "NullLiteral", "NumericLiteral", "BigIntLiteral", "StringLiteral", "RegExpLiteral", "PrivateIn", "EmptyNode")
_FUNCTIONS = ("FunctionDeclaration", "FunctionExpression")
_CLASSES = ("ClassDeclaration", "ClassExpression")


def total(nodes) -> int:
    return sum(units(x) for x in nodes if x is not None)


def _values(nodes) -> int:
    return sum(units(x) for x in nodes if x is not None and x.t != "SpreadElement")


#: Units of a node type beside the default of 1.
_UNITS = {
    "BlockStatement": lambda x: total(x.body),
    "FunctionBody": lambda x: total(x.body),
    "ExpressionStatement": lambda x: 1 + units(x.expression),
    "ReturnStatement": lambda x: 1 + units(x.argument),
    "ThrowStatement": lambda x: 1 + units(x.argument),
    "VariableDeclaration": lambda x: 1 + total(d.init for d in x.declarations),
    "IfStatement": lambda x: 1 + total((x.test, x.consequent, x.alternate)),
    "ForStatement": lambda x: 1 + total((x.init, x.test, x.update, x.body)),
    "ForInStatement": lambda x: 1 + total((x.left, x.right, x.body)),
    "ForOfStatement": lambda x: 1 + total((x.left, x.right, x.body)),
    "WhileStatement": lambda x: 1 + total((x.test, x.body)),
    "DoWhileStatement": lambda x: 1 + total((x.test, x.body)),
    "TryStatement": lambda x: 1 + total((x.block, x.handler and x.handler.body, x.finalizer)),
    "SwitchStatement": lambda x: 1 + units(x.discriminant) + sum(units(c.test) + total(c.consequent) for c in x.cases),
    "LabeledStatement": lambda x: 1 + units(x.body),
    "WithStatement": lambda x: 1 + total((x.object, x.body)),
    "FunctionDeclaration": lambda x: 1 + units(x.body),
    "FunctionExpression": lambda x: 1 + units(x.body),
    "ArrowFunctionExpression": lambda x: 1 + units(x.body),
    "ClassDeclaration": lambda x: 1 + class_units(x),
    "ClassExpression": lambda x: 1 + class_units(x),
    "ExportDefaultDeclaration": lambda x: 1 + units(x.declaration),
    "ExportNamedDeclaration": lambda x: 1 + units(x.declaration),
    "MemberExpression": lambda x: 1 + units(x.object),
    "PrivateMember": lambda x: 1 + units(x.object),
    "ComputedMember": lambda x: 1 + units(x.object) + units(x.property),
    "CallExpression": lambda x: 1 + units(x.callee) + _values(x.arguments),
    "NewExpression": lambda x: 1 + units(x.callee) + _values(x.arguments),
    "AssignmentExpression": lambda x: 1 + units(x.left) + units(x.right),
    "SequenceExpression": lambda x: 1 + total(x.expressions),
    "ConditionalExpression": lambda x: 1 + total((x.test, x.consequent, x.alternate)),
    "LogicalExpression": lambda x: 1 + units(x.left) + units(x.right),
    "BinaryExpression": lambda x: 1 + units(x.left) + units(x.right),
    "UnaryExpression": lambda x: 1 + units(x.argument),
    "AwaitExpression": lambda x: 1 + units(x.argument),
    "YieldExpression": lambda x: 1 + units(x.argument),
    "ArrayExpression": lambda x: 1 + _values(x.elements),
    "ObjectExpression": lambda x: 1 + sum(1 + units(p.argument if p.t == "SpreadElement" else p.value) for p in x.properties),
    "TemplateLiteral": lambda x: 1 + total(x.expressions),
    "TaggedTemplateExpression": lambda x: 1 + units(x.tag) + total(x.quasi.expressions),
    "ImportExpression": lambda x: 1 + units(x.source),
    "ChainExpression": lambda x: 1 + units(x.expression),
    "ArrayPattern": lambda x: 1 + total(x.elements),
    "ObjectPattern": lambda x: 1 + sum(units(p.argument) if p.t == "RestElement" else 1 + units(p.value) for p in x.properties),
    "AssignmentPattern": lambda x: 1 + units(x.left) + units(x.right),
    "RestElement": lambda x: units(x.argument),
}


def units(x: Node | None) -> int:
    if x is None or x.t in _NONE:
        return 0
    found = _UNITS.get(x.t)
    return found(x) if found else 1


def class_units(x: Node) -> int:
    out = 0
    for m in x.body:
        if m.t == "Method":
            out += 1 + units(m.value)
        elif m.t == "StaticBlock":
            out += 1 + total(m.body)
        else:
            out += 1 + units(m.value)
    return out


def eligible(statements: int, unit_count: int, least: int) -> bool:
    return statements >= least or unit_count >= max(0, 2 * least - 1)


@dataclass
class Root:
    digest: str
    canonical: str
    name: str | None
    start: int
    end: int
    stmt_count: int
    units: int


@dataclass
class Analysis:
    digest: str
    tokens: list[str]
    canonical: str
    roots: list[Root] = field(default_factory=list)


class Collector:
    """Visits roots parent first. A node's entry in _INTO names the fields it goes into; what isn't listed ends there."""

    _INTO = {
        "Program": ("body",), "BlockStatement": ("body",), "FunctionBody": ("body",), "ExpressionStatement": ("expression",), "ReturnStatement": ("argument",),
        "ThrowStatement": ("argument",), "LabeledStatement": ("body",), "IfStatement": ("test", "consequent", "alternate"), "ForStatement": ("init", "test", "update", "body"),
        "WhileStatement": ("body",), "DoWhileStatement": ("body",), "ForInStatement": ("right", "body"), "ForOfStatement": ("right", "body"), "VariableDeclaration": ("declarations",),
        "VariableDeclarator": ("init",), "TryStatement": ("block", "handler", "finalizer"), "CatchClause": ("body",), "SwitchStatement": ("cases",), "SwitchCase": ("consequent",),
        "ExportNamedDeclaration": ("declaration",), "ExportDefaultDeclaration": ("declaration",), "ObjectExpression": ("properties",), "Property": ("value",), "CallExpression": ("callee", "arguments"),
        "NewExpression": ("callee", "arguments"), "AssignmentExpression": ("right",), "SequenceExpression": ("expressions",), "ConditionalExpression": ("test", "consequent", "alternate"),
        "LogicalExpression": ("left", "right"), "BinaryExpression": ("left", "right"), "UnaryExpression": ("argument",), "AwaitExpression": ("argument",), "YieldExpression": ("argument",),
        "ArrayExpression": ("elements",), "MemberExpression": ("object",), "PrivateMember": ("object",), "ComputedMember": ("object", "property"), "ChainExpression": ("expression",),
        "TemplateLiteral": ("expressions",), "TaggedTemplateExpression": ("tag", "quasi"), "ImportExpression": ("source",),
    }

    def __init__(self, least: int):
        self.least, self.roots = least, []

    def add(self, x: Node, name: str | None, statements: int, unit_count: int) -> bool:
        if not eligible(statements, unit_count, self.least):
            return False
        stream = Stream(x.inner).root_of(x)
        self.roots.append(Root(stream.digest(), stream.canonical(), name, x.s, x.e, statements, unit_count))
        return True

    def function(self, x: Node) -> None:
        self.add(x, x.id.name if x.id else None, len(x.body.body), units(x.body))
        self.visit(x.body)

    def visit(self, x) -> None:
        if x is None:
            return
        if isinstance(x, list):
            for y in x:
                self.visit(y)
        elif x.t in _FUNCTIONS:
            self.function(x)
        elif x.t == "ArrowFunctionExpression":
            if x.body.t == "FunctionBody":
                self.add(x, None, len(x.body.body), units(x.body))
            self.visit(x.body)
        elif x.t in _CLASSES:
            if self.add(x, x.id.name if x.id else None, len(x.body), class_units(x)):
                for m in x.body:
                    if m.t == "Method":
                        self.function(m.value)
        elif x.t == "SpreadElement":
            pass
        elif x.t == "ObjectExpression":
            for p in x.properties:
                self.visit(p.argument if p.t == "SpreadElement" else p.value)
        else:
            for f in self._INTO.get(x.t, ()):
                self.visit(getattr(x, f))


class Lines:
    """Line from 1 and column from 0, in characters; only a line feed ends a line."""

    def __init__(self, source: str):
        self.starts = [0]
        at = source.find("\n")
        while at >= 0:
            self.starts.append(at + 1)
            at = source.find("\n", at + 1)

    def at(self, offset: int) -> tuple[int, int]:
        line = bisect_right(self.starts, offset)
        return line, offset - self.starts[line - 1]


def analyze(source: str, least: int = DEFAULT_MIN) -> Analysis:
    """Digest of the program and of each eligible root. Raises JsSyntaxError for what can't be parsed."""
    if sys.getrecursionlimit() < 200_000:
        sys.setrecursionlimit(200_000)
    program = parse(source)
    scopes = Scopes(program)
    stream = Stream(scopes.root)
    stream.visit(program)
    collector = Collector(least)
    collector.visit(program)
    return Analysis(stream.digest(), stream.tokens, stream.canonical(), collector.roots)
