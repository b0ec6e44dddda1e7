"""Scopes, and the number of each binding within its own scope.

Scopes: the program; a function or arrow with its parameters and body; blocks, loop heads, switches, catch clauses,
classes and static blocks. ``var`` goes to the nearest function or program. The name of a function or class declaration
belongs to the scope around it, that of an expression to its own. Whether a function declared in a block belongs to the
block is a choice, made in BLOCK_FUNCTIONS. Bindings are numbered from 0 by their first declaration's place.
"""

from __future__ import annotations

from quillmark.jsfront.parser import Node

BLOCK_FUNCTIONS = True
_FUNCTIONS = ("FunctionDeclaration", "FunctionExpression", "ArrowFunctionExpression")
_OWN = ("BlockStatement", "ForStatement", "ForInStatement", "ForOfStatement", "SwitchStatement", "CatchClause", "StaticBlock")


class Scope:
    __slots__ = ("first", "hoist", "last", "names", "number", "parent")

    def __init__(self, parent: Scope | None, first: int, hoist: bool):
        self.parent, self.first, self.last, self.names, self.number = parent, first, first, {}, {}
        self.hoist = self if hoist else parent.hoist

    def declare(self, name: str, at: int) -> None:
        self.names[name] = min(at, self.names.get(name, at))

    def resolve(self, name: str) -> Scope | None:
        scope = self
        while scope is not None and name not in scope.names:
            scope = scope.parent
        return scope

    def within(self, root: Scope) -> bool:
        return root.first <= self.first <= root.last


def bindings(pattern: Node | None):
    """Names that a pattern binds."""
    if pattern is None:
        return
    if pattern.t == "Binding":
        yield pattern
    elif pattern.t == "AssignmentPattern":
        yield from bindings(pattern.left)
    elif pattern.t == "RestElement":
        yield from bindings(pattern.argument)
    elif pattern.t == "ArrayPattern":
        for x in pattern.elements:
            yield from bindings(x)
    elif pattern.t == "ObjectPattern":
        for p in pattern.properties:
            yield from bindings(p.argument if p.t == "RestElement" else p.value)


class Scopes:
    """Gives each identifier node its ``scope`` (where it stands) and each root node its own ``inner`` scope."""

    def __init__(self, program: Node):
        self.count = 0
        self.root = self._new(None, True)
        program.inner = self.root
        self._walk_all(program, self.root)
        self.root.last = self.count

    def _new(self, parent: Scope | None, hoist: bool) -> Scope:
        self.count += 1
        return Scope(parent, self.count, hoist)

    def _close(self, scope: Scope) -> None:
        scope.last = self.count
        for i, name in enumerate(sorted(scope.names, key=scope.names.__getitem__)):
            scope.number[name] = i

    def _walk_all(self, node: Node, scope: Scope) -> None:
        for x in node.children():
            self._walk(x, scope)
        if node.t == "Program":
            self._close(scope)

    def _walk(self, node: Node, scope: Scope) -> None:
        t = node.t
        if t in ("Ident", "Binding"):
            node.scope = scope
            return
        if t in _FUNCTIONS:
            name = getattr(node, "id", None)
            if t == "FunctionDeclaration" and name:
                (scope if BLOCK_FUNCTIONS else scope.hoist).declare(name.name, name.s)
                name.scope = scope
            own = node.inner = self._new(scope, True)
            if t == "FunctionExpression" and name:
                own.declare(name.name, name.s)
                name.scope = own
            for p in node.params:
                for b in bindings(p):
                    own.declare(b.name, b.s)
                self._walk(p, own)
            if node.body.t == "FunctionBody":
                self._walk_all(node.body, own)
            else:
                self._walk(node.body, own)
            self._close(own)
            return
        if t in ("ClassDeclaration", "ClassExpression"):
            if t == "ClassDeclaration" and node.id:
                scope.declare(node.id.name, node.id.s)
                node.id.scope = scope
            for d in node.decorators:
                self._walk(d, scope)
            own = node.inner = self._new(scope, False)
            if t == "ClassExpression" and node.id:
                own.declare(node.id.name, node.id.s)
                node.id.scope = own
            if node.superclass:
                self._walk(node.superclass, own)
            for x in node.body:
                self._walk(x, own)
            self._close(own)
            return
        if t in _OWN:
            own = self._new(scope, t == "StaticBlock")
            if t == "CatchClause":
                for b in bindings(node.param):
                    own.declare(b.name, b.s)
            if t == "SwitchStatement":
                self._walk(node.discriminant, scope)
                for c in node.cases:
                    self._walk_all(c, own)
            else:
                self._walk_all(node, own)
            self._close(own)
            return
        if t == "VariableDeclaration":
            to = scope.hoist if node.kind == "var" else scope
            for d in node.declarations:
                for b in bindings(d.id):
                    to.declare(b.name, b.s)
        elif t in ("ImportSpecifier", "ImportDefaultSpecifier", "ImportNamespaceSpecifier"):
            scope.declare(node.local.name, node.local.s)
        self._walk_all(node, scope)
