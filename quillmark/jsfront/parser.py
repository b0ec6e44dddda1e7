"""A parser of ECMAScript (scripts and modules, classes with private names and decorators, optional chains) to a tree.

Parentheses aren't kept. Patterns are parsed as expressions first where both are possible, and turned into patterns
when an arrow or an assignment follows.
"""

from __future__ import annotations

from quillmark.jsfront.lexer import JsSyntaxError, Lexer, cook, number

_BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
_RESERVED = set("break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with enum".split())
_UNARY = {"!", "~", "+", "-", "typeof", "void", "delete"}


class Node:
    """A tree node; ``t`` is its type, ``s`` and ``e`` are code point offsets, fields are attributes in source order."""

    def __init__(self, t: str, s: int, e: int = 0, **fields):
        self.t, self.s, self.e = t, s, e
        self.__dict__.update(fields)

    def children(self):
        for name, value in self.__dict__.items():
            if name in ("scope", "inner"):
                continue
            if isinstance(value, Node):
                yield value
            elif isinstance(value, list):
                for x in value:
                    if isinstance(x, Node):
                        yield x


class Parser(Lexer):
    def __init__(self, source: str):
        super().__init__(source)
        self.no_in = self.in_async = self.in_generator = False
        self.depth = 0

    # ---- helpers
    def fail(self, why: str = ""):
        raise JsSyntaxError(why or f"unexpected {self.value or 'end'!r} at {self.start}")

    def at(self, value: str) -> bool:
        return self.value == value and (self.kind == "punct" or self.kind == "name" and not self.escaped)

    def eat(self, value: str) -> bool:
        if self.at(value):
            self.next()
            return True
        return False

    def need(self, value: str) -> None:
        if not self.eat(value):
            self.fail()

    def end_node(self, node: Node) -> Node:
        node.e = self.last_end
        return node

    def semicolon(self) -> None:
        if not self.eat(";") and not (self.at("}") or self.kind == "eof" or self.newline):
            self.fail()

    def peek(self) -> tuple:
        state = self.save()
        self.next()
        seen = self.save()
        self.restore(state)
        return seen

    def ident(self) -> str:
        if self.kind != "name" or self.value in _RESERVED and not self.escaped:
            self.fail()
        name = self.value
        self.next()
        return name

    def any_name(self) -> str:
        if self.kind != "name":
            self.fail()
        name = self.value
        self.next()
        return name

    def allow_in(self, parse):
        old, self.no_in = self.no_in, False
        try:
            return parse()
        finally:
            self.no_in = old

    # ---- statements
    def program(self) -> Node:
        node = Node("Program", 0, directives=[], body=[])
        self.body_into(node, "eof")
        node.e = len(self.source)
        return node

    def body_into(self, node: Node, end: str) -> None:
        prologue = True
        while not (self.kind == "eof" if end == "eof" else self.at(end)):
            if self.kind == "eof":
                self.fail()
            if prologue and self.kind == "str":
                text, at = self.source[self.start + 1 : self.end - 1], self.start
                st = self.statement()
                if st.t == "ExpressionStatement" and st.expression.t == "StringLiteral" and st.expression.s == at:
                    node.directives.append(Node("Directive", st.s, st.e, value=cook(text)))
                    continue
            else:
                st = self.statement()
            prologue = False
            node.body.append(st)

    def block(self) -> Node:
        node = Node("BlockStatement", self.start, body=[])
        self.need("{")
        while not self.eat("}"):
            node.body.append(self.statement())
        return self.end_node(node)

    def statement(self) -> Node:
        s, v = self.start, self.value
        if self.kind == "punct":
            if v == "{":
                return self.block()
            if v == ";":
                self.next()
                return Node("EmptyStatement", s, self.last_end)
            if v == "@":
                return self.klass(True, self.decorators())
        elif self.kind == "name" and not self.escaped:
            if method := getattr(self, f"st_{v}", None):
                return self.end_node(method(s))
            if v == "let":
                kind, value = self.peek()[:2]
                if kind == "name" and value not in ("in", "instanceof", "of") or value in ("[", "{"):
                    return self.end_node(self.variable(s, True))
            if v == "async":
                seen = self.peek()
                if seen[0] == "name" and seen[1] == "function" and not seen[4]:
                    self.next()
                    return self.function(s, True, True)
            if v == "import" and self.peek()[1] not in ("(", "."):
                return self.end_node(self.importing(s))
            if v == "function":
                return self.function(s, True, False)
            if v == "class":
                return self.klass(True, [])
            if v not in _RESERVED and self.peek()[1] == ":":
                label = self.ident()
                self.next()
                return self.end_node(Node("LabeledStatement", s, label=label, body=self.statement()))
        expr = self.expression()
        self.semicolon()
        return self.end_node(Node("ExpressionStatement", s, expression=expr))

    def st_var(self, s: int) -> Node:
        return self.variable(s, True)

    st_const = st_var

    def variable(self, s: int, ended: bool) -> Node:
        node = Node("VariableDeclaration", s, kind=self.any_name(), declarations=[])
        while True:
            d = Node("VariableDeclarator", self.start, id=self.binding(), init=None)
            if self.eat("="):
                d.init = self.assignment()
            node.declarations.append(self.end_node(d))
            if not self.eat(","):
                break
        if ended:
            self.semicolon()
        return self.end_node(node)

    def paren(self) -> Node:
        self.need("(")
        expr = self.expression()
        self.need(")")
        return expr

    def st_if(self, s: int) -> Node:
        self.next()
        test, yes = self.paren(), self.statement()
        return Node("IfStatement", s, test=test, consequent=yes, alternate=self.statement() if self.eat("else") else None)

    def st_for(self, s: int) -> Node:
        self.next()
        self.eat("await")
        self.need("(")
        init = None
        old, self.no_in = self.no_in, True
        at = self.start
        if self.at("var") or self.at("const") or self.at("let") and (self.peek()[0] == "name" and self.peek()[1] not in ("in", "of") or self.peek()[1] in ("[", "{")):
            init = self.variable(at, False)
        elif not self.at(";"):
            init = self.expression(cover=True)
        self.no_in = old
        for word, t in (("of", "ForOfStatement"), ("in", "ForInStatement")):
            if init is not None and self.eat(word):
                left = init if init.t == "VariableDeclaration" else self.pattern(init, False)
                right = self.assignment() if word == "of" else self.expression()
                self.need(")")
                return Node(t, s, left=left, right=right, body=self.statement())
        self.need(";")
        test = None if self.at(";") else self.expression()
        self.need(";")
        update = None if self.at(")") else self.expression()
        self.need(")")
        return Node("ForStatement", s, init=init, test=test, update=update, body=self.statement())

    def st_while(self, s: int) -> Node:
        self.next()
        return Node("WhileStatement", s, test=self.paren(), body=self.statement())

    def st_do(self, s: int) -> Node:
        self.next()
        body = self.statement()
        self.need("while")
        node = Node("DoWhileStatement", s, body=body, test=self.paren())
        self.eat(";")
        return node

    def st_switch(self, s: int) -> Node:
        self.next()
        node = Node("SwitchStatement", s, discriminant=self.paren(), cases=[])
        self.need("{")
        while not self.eat("}"):
            case = Node("SwitchCase", self.start, test=None, consequent=[])
            if not self.eat("default"):
                self.need("case")
                case.test = self.expression()
            self.need(":")
            while not (self.at("case") or self.at("default") or self.at("}")):
                case.consequent.append(self.statement())
            node.cases.append(self.end_node(case))
        return node

    def st_return(self, s: int) -> Node:
        self.next()
        arg = None if self.at(";") or self.at("}") or self.kind == "eof" or self.newline else self.expression()
        self.semicolon()
        return Node("ReturnStatement", s, argument=arg)

    def st_throw(self, s: int) -> Node:
        self.next()
        if self.newline:
            self.fail()
        arg = self.expression()
        self.semicolon()
        return Node("ThrowStatement", s, argument=arg)

    def st_try(self, s: int) -> Node:
        self.next()
        node = Node("TryStatement", s, block=self.block(), handler=None, finalizer=None)
        if self.at("catch"):
            c = Node("CatchClause", self.start, param=None, body=None)
            self.next()
            if self.eat("("):
                c.param = self.binding()
                self.need(")")
            c.body = self.block()
            node.handler = self.end_node(c)
        if self.eat("finally"):
            node.finalizer = self.block()
        elif not node.handler:
            self.fail()
        return node

    def st_with(self, s: int) -> Node:
        self.next()
        return Node("WithStatement", s, object=self.paren(), body=self.statement())

    def jump(self, s: int, t: str) -> Node:
        self.next()
        label = self.ident() if self.kind == "name" and not self.newline else None
        self.semicolon()
        return Node(t, s, label=label)

    def st_break(self, s: int) -> Node:
        return self.jump(s, "BreakStatement")

    def st_continue(self, s: int) -> Node:
        return self.jump(s, "ContinueStatement")

    def st_debugger(self, s: int) -> Node:
        self.next()
        self.semicolon()
        return Node("DebuggerStatement", s)

    # ---- modules
    def module_name(self) -> Node:
        s = self.start
        if self.kind == "str":
            node = Node("StringLiteral", s, value=cook(self.source[s + 1 : self.end - 1]))
        else:
            node = Node("Name", s, name=self.value)
            if self.kind != "name":
                self.fail()
        self.next()
        return self.end_node(node)

    def source_string(self) -> Node:
        if self.kind != "str":
            self.fail()
        node = self.module_name()
        if self.at("with") or self.at("assert") and not self.newline:
            self.next()
            self.need("{")
            while not self.eat("}"):
                self.next()
                self.need(":")
                self.next()
                self.eat(",")
        return node

    def local(self) -> Node:
        s = self.start
        return self.end_node(Node("Binding", s, name=self.ident()))

    def importing(self, s: int) -> Node:
        self.next()
        node = Node("ImportDeclaration", s, specifiers=[], source=None)
        if self.kind != "str":
            if self.kind == "name":
                node.specifiers.append(Node("ImportDefaultSpecifier", self.start, local=self.local()))
                self.eat(",")
            if self.eat("*"):
                self.need("as")
                node.specifiers.append(Node("ImportNamespaceSpecifier", self.start, local=self.local()))
            elif self.eat("{"):
                while not self.eat("}"):
                    at = self.start
                    name = self.module_name()
                    own = self.local() if self.eat("as") else Node("Binding", name.s, name.e, name=name.name) if name.t == "Name" else self.fail()
                    node.specifiers.append(Node("ImportSpecifier", at, imported=name, local=own))
                    if not self.at("}"):
                        self.need(",")
            self.need("from")
        node.source = self.source_string()
        self.semicolon()
        return node

    def st_export(self, s: int) -> Node:
        self.next()
        if self.eat("*"):
            if self.eat("as"):
                self.module_name()
            self.need("from")
            node = Node("ExportAllDeclaration", s, source=self.source_string())
            self.semicolon()
            return node
        if self.eat("default"):
            at = self.start
            if self.at("function"):
                d = self.function(at, True, False, True)
            elif self.at("async") and self.peek()[1] == "function" and not self.peek()[4]:
                self.next()
                d = self.function(at, True, True, True)
            elif self.at("class") or self.at("@"):
                d = self.klass(True, self.decorators(), True)
            else:
                d = self.assignment()
                self.semicolon()
            return Node("ExportDefaultDeclaration", s, declaration=d)
        if self.eat("{"):
            node = Node("ExportNamedDeclaration", s, declaration=None, specifiers=[], source=None)
            while not self.eat("}"):
                at = self.start
                own = self.module_name()
                out = self.module_name() if self.eat("as") else Node(own.t, own.s, own.e, **({"name": own.name} if own.t == "Name" else {"value": own.value}))
                node.specifiers.append(Node("ExportSpecifier", at, local=own, exported=out))
                if not self.at("}"):
                    self.need(",")
            if self.eat("from"):
                node.source = self.source_string()
            else:
                for x in node.specifiers:
                    if x.local.t == "Name":
                        x.local.t = "Ident"
            self.semicolon()
            return node
        return Node("ExportNamedDeclaration", s, declaration=self.statement(), specifiers=[], source=None)

    # ---- functions and classes
    def function(self, s: int, declared: bool, is_async: bool, nameless: bool = False) -> Node:
        self.need("function")
        generator = self.eat("*")
        name = None
        if self.kind == "name" and not self.at("("):
            name = self.local()
        elif declared and not nameless:
            self.fail()
        node = Node("FunctionDeclaration" if declared else "FunctionExpression", s, id=name)
        self.rest_of_function(node, is_async, generator)
        return self.end_node(node)

    def rest_of_function(self, node: Node, is_async: bool, generator: bool) -> None:
        old = self.in_async, self.in_generator, self.no_in
        self.in_async, self.in_generator, self.no_in = is_async, generator, False
        self.need("(")
        node.params = []
        while not self.eat(")"):
            node.params.append(self.parameter())
            if not self.at(")"):
                self.need(",")
        node.body = self.function_body()
        self.in_async, self.in_generator, self.no_in = old

    def parameter(self) -> Node:
        s = self.start
        decorators = self.decorators()
        if self.eat("..."):
            return self.end_node(Node("RestElement", s, argument=self.binding()))
        p = self.with_default(self.binding())
        p.decorators = decorators
        return p

    def function_body(self) -> Node:
        node = Node("FunctionBody", self.start, directives=[], body=[])
        self.need("{")
        self.body_into(node, "}")
        self.next()
        return self.end_node(node)

    def method_function(self, is_async: bool, generator: bool) -> Node:
        node = Node("FunctionExpression", self.start, id=None)
        self.rest_of_function(node, is_async, generator)
        return self.end_node(node)

    def decorators(self) -> list[Node]:
        found = []
        while self.at("@"):
            s = self.start
            self.next()
            found.append(self.end_node(Node("Decorator", s, expression=self.left_hand())))
        return found

    def klass(self, declared: bool, decorators: list[Node], nameless: bool = False) -> Node:
        s = self.start
        self.need("class")
        node = Node("ClassDeclaration" if declared else "ClassExpression", s, decorators=decorators, id=None, superclass=None, body=[])
        if self.kind == "name" and not self.at("extends") and not self.at("{"):
            node.id = self.local()
        if self.eat("extends"):
            node.superclass = self.left_hand()
        self.need("{")
        while not self.eat("}"):
            if not self.eat(";"):
                node.body.append(self.allow_in(self.member))
        return self.end_node(node)

    def ends_key(self, seen: tuple) -> bool:
        return seen[1] in ("(", "=", ";", "}", ",", ":") and seen[0] == "punct" or seen[0] == "eof"

    def member(self) -> Node:
        decorators, s = self.decorators(), self.start
        if self.at("static"):
            seen = self.peek()
            if seen[1] == "{":
                self.next()
                block = self.block()
                return Node("StaticBlock", s, block.e, body=block.body)
            if not self.ends_key(seen):
                self.next()
        is_async = generator = accessor = False
        kind = "method"
        if self.at("accessor") and not self.ends_key(self.peek()) and not self.peek()[4]:
            self.next()
            accessor = True
        if self.at("async") and not self.ends_key(self.peek()) and not self.peek()[4]:
            self.next()
            is_async = True
        if self.eat("*"):
            generator = True
        if (self.at("get") or self.at("set")) and not self.ends_key(self.peek()) and not (self.peek()[4] and self.peek()[1] == "*"):
            kind = self.any_name()
        key, computed = self.key()
        if self.at("("):
            return self.end_node(Node("Method", s, decorators=decorators, kind=kind, key=key, computed=computed, value=self.method_function(is_async, generator)))
        value = None
        if self.eat("="):
            old, self.in_async = self.in_async, False
            value = self.assignment()
            self.in_async = old
        self.semicolon()
        return self.end_node(Node("AccessorProperty" if accessor else "PropertyDefinition", s, decorators=decorators, key=key, computed=computed, value=value))

    def key(self) -> tuple[Node, bool]:
        s, v = self.start, self.value
        if self.kind == "name":
            self.next()
            return self.end_node(Node("Name", s, name=v)), False
        if self.kind == "priv":
            self.next()
            return self.end_node(Node("PrivateName", s, name=v[1:])), False
        if self.kind in ("str", "num"):
            return self.primary(), False
        self.need("[")
        expr = self.allow_in(self.assignment)
        self.need("]")
        return expr, True

    # ---- patterns
    def binding(self) -> Node:
        s = self.start
        if self.eat("["):
            node = Node("ArrayPattern", s, elements=[])
            while not self.eat("]"):
                if self.at(","):
                    self.next()
                    node.elements.append(None)
                    continue
                at = self.start
                if self.eat("..."):
                    node.elements.append(self.end_node(Node("RestElement", at, argument=self.binding())))
                else:
                    node.elements.append(self.allow_in(lambda: self.with_default(self.binding())))
                if not self.at("]"):
                    self.need(",")
            return self.end_node(node)
        if self.eat("{"):
            node = Node("ObjectPattern", s, properties=[])
            while not self.eat("}"):
                at = self.start
                if self.eat("..."):
                    node.properties.append(self.end_node(Node("RestElement", at, argument=self.binding())))
                else:
                    key, computed = self.key()
                    if self.eat(":"):
                        value = self.allow_in(lambda: self.with_default(self.binding()))
                    elif key.t == "Name":
                        value = self.allow_in(lambda k=key: self.with_default(Node("Binding", k.s, k.e, name=k.name)))
                    else:
                        self.fail()
                    node.properties.append(self.end_node(Node("PatternProperty", at, key=key, computed=computed, value=value)))
                if not self.at("}"):
                    self.need(",")
            return self.end_node(node)
        return self.local()

    def with_default(self, target: Node) -> Node:
        if self.eat("="):
            return self.end_node(Node("AssignmentPattern", target.s, left=target, right=self.allow_in(self.assignment)))
        return target

    def pattern(self, x: Node, binding: bool) -> Node:
        """Turn an expression into a pattern, of bindings or of assignment targets."""
        if x.t == "Ident":
            return Node("Binding", x.s, x.e, name=x.name) if binding else x
        if x.t in ("MemberExpression", "ComputedMember", "PrivateMember") and not binding:
            return x
        if x.t == "AssignmentExpression" and x.operator == "=":
            return Node("AssignmentPattern", x.s, x.e, left=self.pattern(x.left, binding), right=x.right)
        if x.t in ("AssignmentPattern", "ArrayPattern", "ObjectPattern"):
            for name in ("left", "argument"):
                if hasattr(x, name):
                    setattr(x, name, self.pattern(getattr(x, name), binding))
            if x.t == "ArrayPattern":
                x.elements = [y and self.pattern(y, binding) for y in x.elements]
            if x.t == "ObjectPattern":
                for p in x.properties:
                    if p.t == "RestElement":
                        p.argument = self.pattern(p.argument, binding)
                    else:
                        p.value = self.pattern(p.value, binding)
                        p.shorthand = p.shorthand and not binding if hasattr(p, "shorthand") else False
            return x
        if x.t == "RestElement" or x.t == "SpreadElement":
            return Node("RestElement", x.s, x.e, argument=self.pattern(x.argument, binding))
        if x.t == "ArrayExpression":
            return Node("ArrayPattern", x.s, x.e, elements=[y and self.pattern(y, binding) for y in x.elements])
        if x.t == "ObjectExpression":
            found = []
            for p in x.properties:
                if p.t == "SpreadElement":
                    found.append(self.pattern(p, binding))
                elif p.t != "Property" or p.kind != "init":
                    self.fail("not a pattern")
                else:
                    found.append(Node("PatternProperty", p.s, p.e, key=p.key, computed=p.computed, value=self.pattern(p.value, binding), shorthand=p.shorthand and not binding))
            return Node("ObjectPattern", x.s, x.e, properties=found)
        self.fail(f"not a pattern at {x.s}")

    # ---- expressions
    def expression(self, cover: bool = False) -> Node:
        s = self.start
        first = self.assignment()
        if not self.at(","):
            return first
        found = [first]
        while self.eat(","):
            found.append(self.assignment())
        return self.end_node(Node("SequenceExpression", s, expressions=found))

    def arrow_body(self, s: int, params: list[Node], is_async: bool) -> Node:
        self.need("=>")
        node = Node("ArrowFunctionExpression", s, params=params, body=None, expression=not self.at("{"))
        old = self.in_async, self.in_generator, self.no_in
        self.in_async, self.in_generator = is_async, False
        if node.expression:
            node.body = self.assignment()
        else:
            self.no_in = False
            node.body = self.function_body()
        self.in_async, self.in_generator, self.no_in = old
        return self.end_node(node)

    def assignment(self) -> Node:
        s = self.start
        if self.kind == "name" and not self.escaped:
            if self.value == "yield" and self.in_generator:
                self.next()
                node = Node("YieldExpression", s, argument=None)
                if not self.newline:
                    star = self.eat("*")
                    if star or not (self.kind == "eof" or self.kind == "punct" and self.value in (")", "]", "}", ",", ";", ":") or self.value in ("in", "of")):
                        node.argument = self.assignment()
                return self.end_node(node)
            if self.value == "async":
                seen = self.peek()
                if seen[0] == "name" and not seen[4] and seen[1] not in _RESERVED:
                    state = self.save()
                    self.next()
                    name = self.local()
                    if self.at("=>"):
                        return self.arrow_body(s, [name], True)
                    self.restore(state)
        left = self.conditional()
        if self.at("=>") and not self.newline and left.t in ("Ident", "Params"):
            params = left.items if left.t == "Params" else [left]
            return self.arrow_body(s, [self.pattern(p, True) for p in params], getattr(left, "is_async", False))
        if left.t == "Params":
            self.fail()
        if self.kind == "punct" and self.value in _ASSIGN:
            op = self.value
            self.next()
            target = self.pattern(left, False) if op == "=" else left
            if target.t not in ("Ident", "MemberExpression", "ComputedMember", "PrivateMember", "ArrayPattern", "ObjectPattern"):
                self.fail("not an assignment target")
            return self.end_node(Node("AssignmentExpression", s, operator=op, left=target, right=self.assignment()))
        return left

    def conditional(self) -> Node:
        s = self.start
        test = self.binary()
        if test.t == "Params" or not self.at("?"):
            return test
        self.next()
        yes = self.allow_in(self.assignment)
        self.need(":")
        return self.end_node(Node("ConditionalExpression", s, test=test, consequent=yes, alternate=self.assignment()))

    def binary(self) -> Node:
        """Operators by precedence with a stack of our own: long chains take no recursion."""
        stack: list[tuple[Node, str, int]] = []
        left = self.private_in() if self.kind == "priv" else self.unary()
        while True:
            rank = _BINARY.get(self.value, 0) if self.kind in ("punct", "name") and not self.escaped and left.t != "Params" else 0
            if self.value == "in" and self.no_in:
                rank = 0
            while stack and (stack[-1][2] > rank or stack[-1][2] == rank and rank != 12):
                one, op, _ = stack.pop()
                left = self.join(one, op, left)
            if not rank:
                return left
            stack.append((left, self.value, rank))
            self.next()
            left = self.private_in() if self.kind == "priv" else self.unary()

    def join(self, left: Node, op: str, right: Node) -> Node:
        t = "LogicalExpression" if op in ("&&", "||", "??") else "PrivateIn" if left.t == "PrivateName" else "BinaryExpression"
        return Node(t, left.s, right.e, operator=op, left=left, right=right)

    def private_in(self) -> Node:
        node = Node("PrivateName", self.start, self.end, name=self.value[1:])
        self.next()
        if not self.at("in"):
            self.fail()
        return node

    def unary(self) -> Node:
        s, v = self.start, self.value
        if self.kind == "punct" or self.kind == "name" and not self.escaped:
            if v in _UNARY:
                self.next()
                return self.end_node(Node("UnaryExpression", s, operator=v, argument=self.unary()))
            if v in ("++", "--"):
                self.next()
                return self.end_node(Node("UpdateExpression", s, operator=v, argument=self.unary()))
            if v == "await" and self.kind == "name" and self.awaits():
                self.next()
                return self.end_node(Node("AwaitExpression", s, argument=self.unary()))
        x = self.left_hand()
        if self.kind == "punct" and self.value in ("++", "--") and not self.newline:
            x = Node("UpdateExpression", s, operator=self.value, argument=x)
            self.next()
            self.end_node(x)
        return x

    def awaits(self) -> bool:
        if self.in_async:
            return True
        kind, value, _, _, newline = self.peek()[:5]  # at the top of a module; else a name
        return not newline and (kind in ("name", "num", "str") and value not in ("in", "of", "instanceof") or value in ("{", "!", "~"))

    def arguments(self) -> list[Node]:
        self.need("(")
        found = []
        while not self.eat(")"):
            found.append(self.allow_in(self.spread_or_assignment))
            if not self.at(")"):
                self.need(",")
        return found

    def spread_or_assignment(self) -> Node:
        s = self.start
        if self.eat("..."):
            return self.end_node(Node("SpreadElement", s, argument=self.assignment()))
        return self.assignment()

    def left_hand(self) -> Node:
        s = self.start
        if self.at("new"):
            x = self.new()
        else:
            x = self.primary()
        if x.t in ("Params", "ArrowFunctionExpression"):
            return x
        return self.suffixes(x, s, True)

    def suffixes(self, x: Node, s: int, calls: bool) -> Node:
        chain = False
        while True:
            if self.kind != "punct":
                break
            v = self.value
            optional = v == "?." and calls
            if optional:
                self.next()
                chain, v = True, self.value if self.value in ("(", "[") and self.kind == "punct" else "."
            elif v == ".":
                self.next()
            if v == ".":
                at = self.start
                if self.kind == "priv":
                    x = Node("PrivateMember", s, object=x, property=Node("PrivateName", at, self.end, name=self.value[1:]))
                    self.next()
                else:
                    x = Node("MemberExpression", s, object=x, name=self.any_name())
            elif v == "[":
                self.next()
                x = Node("ComputedMember", s, object=x, property=self.allow_in(self.expression))
                self.need("]")
            elif v == "(" and calls:
                was_async = x.t == "Ident" and x.name == "async" and not self.newline and not optional
                args = self.arguments_or_params(was_async)
                if self.at("=>") and was_async and not self.newline:
                    return Node("Params", s, self.last_end, items=args, is_async=True)
                x = Node("CallExpression", s, callee=x, arguments=args)
            elif v == "`":
                x = Node("TaggedTemplateExpression", s, tag=x, quasi=self.template())
            else:
                break
            self.end_node(x)
        return Node("ChainExpression", x.s, x.e, expression=x) if chain else x

    def arguments_or_params(self, cover: bool) -> list[Node]:
        return self.arguments()

    def new(self) -> Node:
        s = self.start
        self.need("new")
        if self.eat("."):
            self.need("target")
            return self.end_node(Node("MetaProperty", s, meta="new", property="target"))
        at = self.start
        callee = self.new() if self.at("new") else self.primary()
        callee = self.suffixes(callee, at, False)
        return self.end_node(Node("NewExpression", s, callee=callee, arguments=self.arguments() if self.at("(") else []))

    def template(self) -> Node:
        node = Node("TemplateLiteral", self.start, quasis=[], expressions=[])
        raw, done = self.template_part(self.start + 1)
        node.quasis.append(raw)
        while not done:
            self.next()
            node.expressions.append(self.allow_in(self.expression))
            if not self.at("}"):
                self.fail()
            raw, done = self.template_part(self.start + 1)
            node.quasis.append(raw)
        self.next()
        return self.end_node(node)

    def primary(self) -> Node:
        s, v, kind = self.start, self.value, self.kind
        if kind == "num":
            self.next()
            n = number(v)
            return Node("BigIntLiteral", s, self.last_end, value=str(n)) if isinstance(n, int) else Node("NumericLiteral", s, self.last_end, value=n)
        if kind == "str":
            self.next()
            return Node("StringLiteral", s, self.last_end, value=cook(v[1:-1]))
        if kind == "punct":
            if v == "(":
                return self.parenthesized(s)
            if v == "[":
                self.next()
                node = Node("ArrayExpression", s, elements=[])
                while not self.eat("]"):
                    if self.eat(","):
                        node.elements.append(None)
                        continue
                    node.elements.append(self.allow_in(self.spread_or_assignment))
                    if not self.at("]"):
                        self.need(",")
                return self.end_node(node)
            if v == "{":
                self.next()
                node = Node("ObjectExpression", s, properties=[])
                while not self.eat("}"):
                    node.properties.append(self.allow_in(self.property))
                    if not self.at("}"):
                        self.need(",")
                return self.end_node(node)
            if v in ("/", "/="):
                pattern, flags = self.regex()
                return self.end_node(Node("RegExpLiteral", s, pattern=pattern, flags=flags))
            if v == "`":
                return self.template()
            if v == "@":
                return self.klass(False, self.decorators())
            self.fail()
        if kind != "name":
            self.fail()
        if not self.escaped:
            if v in ("true", "false"):
                self.next()
                return Node("BooleanLiteral", s, self.last_end, value=v == "true")
            if v in ("null", "this", "super"):
                self.next()
                return Node({"null": "NullLiteral", "this": "ThisExpression", "super": "Super"}[v], s, self.last_end)
            if v == "function":
                return self.function(s, False, False)
            if v == "class":
                return self.klass(False, [])
            if v == "async":
                seen = self.peek()
                if seen[0] == "name" and seen[1] == "function" and not seen[4]:
                    self.next()
                    return self.function(s, False, True)
            if v == "import":
                self.next()
                if self.eat("."):
                    if self.at("meta"):
                        self.next()
                        return self.end_node(Node("MetaProperty", s, meta="import", property="meta"))
                    self.any_name()
                args = self.arguments()
                if not args:
                    self.fail()
                return self.end_node(Node("ImportExpression", s, source=args[0], options=args[1:]))
        name = self.ident()
        return self.end_node(Node("Ident", s, name=name))

    def parenthesized(self, s: int) -> Node:
        """An expression in parentheses, or what an arrow must follow."""
        self.next()
        found, plain = [], True
        old, self.no_in = self.no_in, False
        while not self.at(")"):
            at = self.start
            if self.eat("..."):
                plain = False
                found.append(self.end_node(Node("RestElement", at, argument=self.binding())))
            else:
                found.append(self.assignment())
            if not self.at(")"):
                self.need(",")
                plain = plain and not self.at(")")
        self.next()
        self.no_in = old
        if self.at("=>") and not self.newline:
            return Node("Params", s, self.last_end, items=found)
        if not plain or not found:
            self.fail()
        return found[0] if len(found) == 1 else Node("SequenceExpression", found[0].s, found[-1].e, expressions=found)

    def property(self) -> Node:
        s = self.start
        if self.eat("..."):
            return self.end_node(Node("SpreadElement", s, argument=self.assignment()))
        is_async = generator = False
        kind = "init"
        if self.at("async") and not self.ends_key(self.peek()) and not self.peek()[4]:
            self.next()
            is_async = True
        if self.eat("*"):
            generator = True
        elif (self.at("get") or self.at("set")) and not self.ends_key(self.peek()):
            kind = self.any_name()
        reserved = self.kind == "name" and self.value in _RESERVED
        key, computed = self.key()
        node = Node("Property", s, kind=kind, key=key, computed=computed, value=None, shorthand=False)
        if self.at("("):
            node.kind = kind if kind != "init" else "method"
            node.value = self.method_function(is_async, generator)
        elif self.eat(":"):
            node.value = self.assignment()
        elif key.t == "Name" and not computed and not reserved:
            own = Node("Ident", key.s, key.e, name=key.name)
            node.shorthand = True
            node.value = own
            if self.eat("="):  # only in a pattern
                node.value = Node("AssignmentPattern", s, self.last_end, left=own, right=self.assignment())
        else:
            self.fail()
        return self.end_node(node)


def parse(source: str) -> Node:
    return Parser(source).program()
