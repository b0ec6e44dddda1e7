"""The normalised token stream of a tree, and its digest.

Most nodes are their type, then operator and children in order; the table below lists them. Exceptions are methods.
Names of node types, prefixes of literals and the framing are fixed values of the hash format.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

from quillmark.jsfront.parser import Node
from quillmark.jsfront.scope import Scope

#: Node type -> fields visited in order; "+x" is a token field.
_PLAIN = {
    "ExpressionStatement": ("expression",),
    "DebuggerStatement": (),
    "IfStatement": ("test", "consequent", "alternate"),
    "ForStatement": ("init", "test", "update", "body"),
    "ForInStatement": ("left", "right", "body"),
    "ForOfStatement": ("left", "right", "body"),
    "WhileStatement": ("test", "body"),
    "DoWhileStatement": ("body", "test"),
    "SwitchStatement": ("discriminant", "cases"),
    "SwitchCase": ("test", "consequent"),
    "ThrowStatement": ("argument",),
    "TryStatement": ("block", "handler", "finalizer"),
    "CatchClause": ("param", "body"),
    "WithStatement": ("object", "body"),
    "VariableDeclaration": ("declarations",),
    "VariableDeclarator": ("id", "init"),
    "FunctionDeclaration": ("id", "params", "body"),
    "FunctionExpression": ("id", "params", "body"),
    "Decorator": ("expression",),
    "StaticBlock": ("body",),
    "BlockStatement": ("body",),
    "ThisExpression": (),
    "Super": (),
    "AwaitExpression": ("argument",),
    "YieldExpression": ("argument",),
    "ImportExpression": ("source",),
    "SequenceExpression": ("expressions",),
    "TaggedTemplateExpression": ("tag", "quasi"),
    "UpdateExpression": ("+operator", "argument"),
    "AssignmentExpression": ("+operator", "left", "right"),
    "BinaryExpression": ("+operator", "left", "right"),
    "LogicalExpression": ("+operator", "left", "right"),
    "ConditionalExpression": ("test", "consequent", "alternate"),
    "NewExpression": ("callee", "arguments"),
    "SpreadElement": ("argument",),
    "RestElement": ("argument",),
    "ArrayExpression": ("elements",),
    "ArrayPattern": ("elements",),
    "ObjectPattern": ("properties",),
    "AssignmentPattern": ("left", "right"),
    "ImportSpecifier": ("imported", "local"),
    "ImportDefaultSpecifier": ("local",),
    "ImportNamespaceSpecifier": ("local",),
    "ExportSpecifier": ("local", "exported"),
    "ExportDefaultDeclaration": ("declaration",),
    "ExportAllDeclaration": ("source",),
}
_MEMBERS = ("MemberExpression", "ComputedMember", "PrivateMember")


def number_text(value: float) -> str:
    """Whole numbers below 1e20 as integers that fit 64 bits, all others in decimals without exponent."""
    if value == int(value) if abs(value) < 1e300 else False:
        if abs(value) < 1e20:
            return str(max(-(2**63), min(2**63 - 1, int(value))))
    return format(Decimal(repr(value)), "f") if abs(value) != float("inf") else "inf" if value > 0 else "-inf"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace(",", "\\,")


def is_nothing(x: Node | None) -> bool:
    """``void 0``, or an identifier called undefined."""
    return x is not None and (x.t == "Ident" and x.name == "undefined" or _void_zero(x))


def _void_zero(x: Node) -> bool:
    return x.t == "UnaryExpression" and x.operator == "void" and x.argument.t == "NumericLiteral" and x.argument.value == 0


def sort_key(p: Node) -> bytes:
    if p.t != "Property" or p.computed:
        return b""
    k = p.key
    text = k.name if k.t == "Name" else k.value if k.t == "StringLiteral" else number_text(k.value) if k.t == "NumericLiteral" else ""
    return text.encode("utf-8", "surrogatepass")


class Stream:
    """Tokens of one root. ``root`` is the scope whose bindings, and those below it, are local."""

    def __init__(self, root: Scope):
        self.root, self.tokens, self.framed = root, [], []
        self.free: dict[str, int] = {}
        self.labels: dict[str, int] = {}

    # ---- framing
    def push(self, token: str) -> None:
        self.tokens.append(token)
        self.framed.append(escape(token))

    def literal(self, t: str, prefix: str, value: str) -> None:
        self.push(t)
        self.tokens.append(prefix + value)
        self.framed.append(prefix + escape(value))

    def text(self) -> str:
        return ",".join(self.framed)

    def canonical(self) -> str:
        return ",".join(self.tokens)

    def digest(self) -> str:
        return hashlib.sha256(self.text().encode("utf-8", "surrogatepass")).hexdigest()

    # ---- identifiers
    def name_ref(self, name: str, scope: Scope | None) -> None:
        self.push("Identifier")
        found = scope.resolve(name) if scope is not None else None
        if found is not None and found.within(self.root):
            self.push(f"L{found.number[name]}")
        else:
            self.push(f"F{self.free.setdefault(name, len(self.free))}")

    def plain_name(self, name: str) -> None:
        self.push("Identifier")
        self.push(name)

    def label(self, name: str) -> None:
        self.push("Identifier")
        self.push(f"$L{self.labels.setdefault(name, len(self.labels))}")

    # ---- walk
    def visit(self, x) -> None:
        if x is None:
            return
        if isinstance(x, list):
            for y in x:
                self.visit(y)
            return
        if (own := getattr(self, f"on_{x.t}", None)) is not None:
            own(x)
        elif (fields := _PLAIN.get(x.t)) is not None:
            self.push(x.t)
            for f in fields:
                if f[0] == "+":
                    self.push(getattr(x, f[1:]))
                else:
                    self.visit(getattr(x, f))

    def root_of(self, x: Node) -> Stream:
        """The stream of a function or class as a root: without its own type and name."""
        if x.t in ("ClassDeclaration", "ClassExpression"):
            self.visit(x.decorators)
            self.visit(x.superclass)
            self.class_body(x)
        else:
            self.visit(x.params)
            self.arrow_body(x) if x.t == "ArrowFunctionExpression" else self.visit(x.body)
        return self

    def on_Program(self, x: Node) -> None:
        self.push("Program")
        self.visit(x.directives)
        self.visit(x.body)

    def on_Directive(self, x: Node) -> None:
        self.push("ExpressionStatement")
        self.literal("StringLiteral", "S:", x.value)

    def on_FunctionBody(self, x: Node) -> None:
        self.push("BlockStatement")
        self.visit(x.directives)
        self.visit(x.body)

    def on_EmptyStatement(self, x: Node) -> None:
        pass

    def on_ReturnStatement(self, x: Node) -> None:
        self.push(x.t)
        if not is_nothing(x.argument):
            self.visit(x.argument)

    def on_LabeledStatement(self, x: Node) -> None:
        self.push(x.t)
        self.label(x.label)
        self.visit(x.body)

    def on_BreakStatement(self, x: Node) -> None:
        self.push(x.t)
        if x.label:
            self.label(x.label)

    on_ContinueStatement = on_BreakStatement

    def on_ArrowFunctionExpression(self, x: Node) -> None:
        self.push(x.t)
        self.visit(x.params)
        self.arrow_body(x)

    def arrow_body(self, x: Node) -> None:
        b = x.body
        if b.t == "FunctionBody" and not b.directives and len(b.body) == 1:
            only = b.body[0]
            if only.t == "ExpressionStatement":
                return self.visit(only.expression)
            if only.t == "ReturnStatement" and only.argument is not None and not is_nothing(only.argument):
                return self.visit(only.argument)
        self.visit(b)

    def on_ClassDeclaration(self, x: Node) -> None:
        self.push(x.t)
        self.visit(x.decorators)
        self.visit(x.id)
        self.visit(x.superclass)
        self.class_body(x)

    on_ClassExpression = on_ClassDeclaration

    def class_body(self, x: Node) -> None:
        self.push("ClassBody")
        self.visit(x.body)

    def on_Method(self, x: Node) -> None:
        self.push("ClassPrivateMethod" if x.key.t == "PrivateName" else "ClassMethod")
        self.visit(x.decorators)
        self.key(x)
        self.visit(x.value.params)
        self.visit(x.value.body)

    def on_PropertyDefinition(self, x: Node) -> None:
        self.push("ClassPrivateProperty" if x.key.t == "PrivateName" else "ClassProperty")
        self.visit(x.decorators)
        self.key(x)
        self.visit(x.value)

    def on_AccessorProperty(self, x: Node) -> None:
        self.push("ClassAccessorProperty")
        self.visit(x.decorators)
        self.key(x)
        self.visit(x.value)

    def key(self, x: Node) -> None:
        k = x.key
        if k.t == "Name":
            self.plain_name(k.name)
        elif k.t == "StringLiteral":
            self.plain_name(k.value)
        else:
            self.visit(k)

    def on_PrivateName(self, x: Node) -> None:
        self.push("PrivateName")
        self.plain_name(x.name)

    def on_Name(self, x: Node) -> None:
        self.plain_name(x.name)

    def on_Ident(self, x: Node) -> None:
        self.name_ref(x.name, getattr(x, "scope", None))

    on_Binding = on_Ident

    def on_BooleanLiteral(self, x: Node) -> None:
        self.push(x.t)
        self.push("B:true" if x.value else "B:false")

    def on_NullLiteral(self, x: Node) -> None:
        self.push(x.t)
        self.push("NULL")

    def on_NumericLiteral(self, x: Node) -> None:
        self.literal(x.t, "N:", number_text(x.value))

    def on_BigIntLiteral(self, x: Node) -> None:
        self.literal(x.t, "I:", x.value)

    def on_StringLiteral(self, x: Node) -> None:
        self.literal(x.t, "S:", x.value)

    def on_RegExpLiteral(self, x: Node) -> None:
        self.push(x.t)
        self.tokens.append(f"R:{x.pattern}:{x.flags}")
        self.framed.append(f"R:{escape(x.pattern)}:{escape(x.flags)}")

    def on_MetaProperty(self, x: Node) -> None:
        self.push(x.t)
        self.plain_name(x.meta)
        self.plain_name(x.property)

    def on_UnaryExpression(self, x: Node) -> None:
        a = x.argument
        if x.operator == "!" and a.t == "NumericLiteral" and a.value in (0, 1):
            self.push("BooleanLiteral")
            self.push("B:true" if a.value == 0 else "B:false")
        elif _void_zero(x):
            self.name_ref("undefined", None)
        else:
            self.push(x.t)
            self.push(x.operator)
            self.visit(a)

    def on_PrivateIn(self, x: Node) -> None:
        self.push("BinaryExpression")
        self.visit(x.left)
        self.visit(x.right)

    def on_TemplateLiteral(self, x: Node) -> None:
        if not x.expressions:
            return self.literal("StringLiteral", "S:", x.quasis[0])
        self.push(x.t)
        for q in x.quasis:
            self.literal("TemplateElement", "T:", q)
        self.visit(x.expressions)

    def on_ObjectExpression(self, x: Node) -> None:
        self.push(x.t)
        for p in sorted(x.properties, key=sort_key):
            self.visit(p)

    def on_Property(self, x: Node) -> None:
        if x.kind == "init":
            self.push("ObjectProperty")
            self.key(x)
            self.visit(x.value)
        else:
            self.push("ObjectMethod")
            self.key(x)
            self.visit(x.value.params)
            self.visit(x.value.body)

    def on_PatternProperty(self, x: Node) -> None:
        self.push("ObjectProperty")
        if not getattr(x, "shorthand", False):
            self.key(x)
            return self.visit(x.value)
        target = x.value.left if x.value.t == "AssignmentPattern" else x.value
        self.visit(target)  # in an assignment, the shorthand is the reference itself
        if x.value.t == "AssignmentPattern":
            self.visit(x.value)

    def on_CallExpression(self, x: Node, optional: bool = False) -> None:
        self.push("OptionalCallExpression" if optional else "CallExpression")
        self.visit(x.callee)
        self.visit(x.arguments)

    def on_MemberExpression(self, x: Node, optional: bool = False) -> None:
        self.push("OptionalMemberExpression" if optional else "MemberExpression")
        self.visit(x.object)
        if x.t == "MemberExpression":
            self.plain_name(x.name)
        elif x.t == "ComputedMember" and x.property.t == "StringLiteral":
            self.plain_name(x.property.value)
        else:
            self.visit(x.property)

    on_ComputedMember = on_PrivateMember = on_MemberExpression

    def on_ChainExpression(self, x: Node) -> None:
        inner = x.expression
        if inner.t == "CallExpression":
            self.on_CallExpression(inner, True)
        elif inner.t in _MEMBERS:
            self.on_MemberExpression(inner, True)
        else:
            self.visit(inner)

    def on_ImportDeclaration(self, x: Node) -> None:
        self.push(x.t)
        self.visit(x.specifiers)
        self.visit(x.source)

    def on_ExportNamedDeclaration(self, x: Node) -> None:
        self.push(x.t)
        if x.declaration:
            return self.visit(x.declaration)
        self.visit(x.specifiers)
        self.visit(x.source)
