"""Queries over the language: for each kind of node, unit and way into a script, a source with a number {n} in it, and what
it must give. Sources are made for every p_size of part. What they must give is written out here by the rules of the
hash format, and digested by the engine that checks the query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.hashes import PREFIX
from quillmark.operators import analyze as an

_F0, _F1, _F2 = ("CallExpression,Identifier,F%d,NumericLiteral,N:{n}" % i for i in range(3))
_X = f"ExpressionStatement,{_F0}"
_CALL = "ExpressionStatement,CallExpression,Identifier,"
_ARG = f"{_CALL}F0,"
_SET = "ExpressionStatement,AssignmentExpression,=,"
_NUM = "NumericLiteral,N:{n}"
_VAR = "VariableDeclaration,VariableDeclarator,"

#: Group -> name -> (source, stream of the program after its first token).
STREAMS: dict[str, dict[str, tuple[str, str]]] = {
    "statements": {
        "directive": ('"use strict";f({n})', f"ExpressionStatement,StringLiteral,S:use strict,{_X}"),
        "block": ("{f({n})}", f"BlockStatement,{_X}"),
        "empty": (";;f({n})", _X),
        "debugger": ("debugger;f({n})", f"DebuggerStatement,{_X}"),
        "if": ("if(a)f({n});else g()", f"IfStatement,Identifier,F0,ExpressionStatement,{_F1},{_CALL}F2"),
        "for": ("for(var i=0;i<{n};i++)f(i)", f"ForStatement,{_VAR}Identifier,L0,NumericLiteral,N:0,BinaryExpression,<,Identifier,L0,{_NUM},UpdateExpression,++,Identifier,L0,{_CALL}F0,Identifier,L0"),
        "for without parts": ("for(;;)f({n})", f"ForStatement,{_X}"),
        "for in": ("for(k in o)f({n})", f"ForInStatement,Identifier,F0,Identifier,F1,ExpressionStatement,{_F2}"),
        "for of": ("for(const k of o)f(k,{n})", f"ForOfStatement,{_VAR}Identifier,L0,Identifier,F0,{_CALL}F1,Identifier,L0,{_NUM}"),
        "while": ("while(a)f({n})", f"WhileStatement,Identifier,F0,ExpressionStatement,{_F1}"),
        "do while": ("do f({n});while(a)", f"DoWhileStatement,{_X},Identifier,F1"),
        "switch": ("switch(a){case {n}:f();break;default:g()}", f"SwitchStatement,Identifier,F0,SwitchCase,{_NUM},{_CALL}F1,BreakStatement,SwitchCase,{_CALL}F2"),
        "return": ("return {n}", f"ReturnStatement,{_NUM}"),
        "return nothing": ("function f(){return void 0}f({n})", f"FunctionDeclaration,Identifier,L0,BlockStatement,ReturnStatement,{_CALL}L0,{_NUM}"),
        "throw": ("throw {n}", f"ThrowStatement,{_NUM}"),
        "try": ("try{f({n})}catch(e){g(e)}finally{h()}", f"TryStatement,BlockStatement,{_X},CatchClause,Identifier,L0,BlockStatement,{_CALL}F1,Identifier,L0,BlockStatement,{_CALL}F2"),
        "catch without name": ("try{f({n})}catch{g()}", f"TryStatement,BlockStatement,{_X},CatchClause,BlockStatement,{_CALL}F1"),
        "labels": ("a:for(;;){b:for(;;){continue a;break b}}f({n})", f"LabeledStatement,Identifier,$L0,ForStatement,BlockStatement,LabeledStatement,Identifier,$L1,ForStatement,BlockStatement,ContinueStatement,Identifier,$L0,BreakStatement,Identifier,$L1,{_X}"),
        "with": ("with(o)f({n})", f"WithStatement,Identifier,F0,ExpressionStatement,{_F1}"),
        "declarations": ("let a={n},b;const c=a", f"{_VAR}Identifier,L0,{_NUM},VariableDeclarator,Identifier,L1,{_VAR}Identifier,L2,Identifier,L0"),
    },
    "functions": {
        "expression": ("f(function(a){return a+{n}})", f"{_ARG}FunctionExpression,Identifier,L0,BlockStatement,ReturnStatement,BinaryExpression,+,Identifier,L0,{_NUM}"),
        "directive": ('function f(){"x";g({n})}', f"FunctionDeclaration,Identifier,L0,BlockStatement,ExpressionStatement,StringLiteral,S:x,{_X}"),
        "async generator": ("async function*g(){yield* x;await y;yield {n}}", f"FunctionDeclaration,Identifier,L0,BlockStatement,ExpressionStatement,YieldExpression,Identifier,F0,ExpressionStatement,AwaitExpression,Identifier,F1,ExpressionStatement,YieldExpression,{_NUM}"),
        "parameters": ("f(function(a=1,...r){return r},{n})", f"{_ARG}FunctionExpression,AssignmentPattern,Identifier,L0,NumericLiteral,N:1,RestElement,Identifier,L1,BlockStatement,ReturnStatement,Identifier,L1,{_NUM}"),
        "arrow": ("f(x=>x+{n})", f"{_ARG}ArrowFunctionExpression,Identifier,L0,BinaryExpression,+,Identifier,L0,{_NUM}"),
        "arrow that returns": ("f(x=>{return x+{n}})", f"{_ARG}ArrowFunctionExpression,Identifier,L0,BinaryExpression,+,Identifier,L0,{_NUM}"),
        "arrow of one statement": ("f(x=>{g({n})})", f"{_ARG}ArrowFunctionExpression,Identifier,L0,{_F1}"),
        "arrow of two statements": ("f(x=>{g();h({n})})", f"{_ARG}ArrowFunctionExpression,Identifier,L0,BlockStatement,{_CALL}F1,ExpressionStatement,{_F2}"),
        "arrow that returns nothing": ("f(x=>{return undefined});g({n})", f"{_ARG}ArrowFunctionExpression,Identifier,L0,BlockStatement,ReturnStatement,ExpressionStatement,{_F1}"),
    },
    "classes": {
        "methods": ("class A extends B{constructor(a){super(a)}static m(){return this}get [k](){return {n}}#p(){}}", f"ClassDeclaration,Identifier,L0,Identifier,F0,ClassBody,ClassMethod,Identifier,constructor,Identifier,L0,BlockStatement,ExpressionStatement,CallExpression,Super,Identifier,L0,ClassMethod,Identifier,m,BlockStatement,ReturnStatement,ThisExpression,ClassMethod,Identifier,F1,BlockStatement,ReturnStatement,{_NUM},ClassPrivateMethod,PrivateName,Identifier,p,BlockStatement"),
        "properties": ('x=class{a={n};static "b"=2;#c;static{f()}}', f"{_SET}Identifier,F0,ClassExpression,ClassBody,ClassProperty,Identifier,a,{_NUM},ClassProperty,Identifier,b,NumericLiteral,N:2,ClassPrivateProperty,PrivateName,Identifier,c,StaticBlock,{_CALL}F1"),
        "decorators": ("@d class A{@e accessor z={n}}", f"ClassDeclaration,Decorator,Identifier,F0,Identifier,L0,ClassBody,ClassAccessorProperty,Decorator,Identifier,F1,Identifier,z,{_NUM}"),
        "private names": ("class A{#x;m(o){return #x in o}g(){return this.#x+{n}}}", f"ClassDeclaration,Identifier,L0,ClassBody,ClassPrivateProperty,PrivateName,Identifier,x,ClassMethod,Identifier,m,Identifier,L0,BlockStatement,ReturnStatement,BinaryExpression,PrivateName,Identifier,x,Identifier,L0,ClassMethod,Identifier,g,BlockStatement,ReturnStatement,BinaryExpression,+,MemberExpression,ThisExpression,PrivateName,Identifier,x,{_NUM}"),
    },
    "literals": {
        "booleans": ("f(true,false,null,{n})", f"{_ARG}BooleanLiteral,B:true,BooleanLiteral,B:false,NullLiteral,NULL,{_NUM}"),
        "short booleans": ("f(!0,!1,!2,{n})", f"{_ARG}BooleanLiteral,B:true,BooleanLiteral,B:false,UnaryExpression,!,NumericLiteral,N:2,{_NUM}"),
        "numbers": ("f(1.5,0x10,1e3,.25,0b11,1_000,{n})", f"{_ARG}NumericLiteral,N:1.5,NumericLiteral,N:16,NumericLiteral,N:1000,NumericLiteral,N:0.25,NumericLiteral,N:3,NumericLiteral,N:1000,{_NUM}"),
        "bigint": ("f(12n,{n})", f"{_ARG}BigIntLiteral,I:12,{_NUM}"),
        "expression": (r"f(/a,b\/c/gi,{n})", rf"{_ARG}RegExpLiteral,R:a\,b\\/c:gi,{_NUM}"),
        "string": (r'f("a\\b,cAé",{n})', rf"{_ARG}StringLiteral,S:a\\b\,cAé,{_NUM}"),
        "plain template": (r"f(`a\n`,{n})", rf"{_ARG}StringLiteral,S:a\\n,{_NUM}"),
        "template": ("f(`a${x}b${y}c`,{n})", f"{_ARG}TemplateLiteral,TemplateElement,T:a,TemplateElement,T:b,TemplateElement,T:c,Identifier,F1,Identifier,F2,{_NUM}"),
        "tagged template": ("t`a${x}b`;f({n})", f"ExpressionStatement,TaggedTemplateExpression,Identifier,F0,TemplateLiteral,TemplateElement,T:a,TemplateElement,T:b,Identifier,F1,ExpressionStatement,{_F2}"),
        "array": ("f([1,,...a,{n}])", f"{_ARG}ArrayExpression,NumericLiteral,N:1,SpreadElement,Identifier,F1,{_NUM}"),
        "object in order of keys": ("f({b:1,a:{n},...s,[k]:2})", f"{_ARG}ObjectExpression,SpreadElement,Identifier,F1,ObjectProperty,Identifier,F2,NumericLiteral,N:2,ObjectProperty,Identifier,a,{_NUM},ObjectProperty,Identifier,b,NumericLiteral,N:1"),
        "object methods": ("f({x,get y(){return {n}},z(){}})", f"{_ARG}ObjectExpression,ObjectProperty,Identifier,x,Identifier,F1,ObjectMethod,Identifier,y,BlockStatement,ReturnStatement,{_NUM},ObjectMethod,Identifier,z,BlockStatement"),
        "object keys": ('f({["q"]:{n},"a b":1,3:2})', f"{_ARG}ObjectExpression,ObjectProperty,Identifier,q,{_NUM},ObjectProperty,NumericLiteral,N:3,NumericLiteral,N:2,ObjectProperty,Identifier,a b,NumericLiteral,N:1"),
    },
    "expressions": {
        "void 0": ("f(void 0,{n})", f"{_ARG}Identifier,F1,{_NUM}"),
        "unary": ("typeof a;delete a.b;-{n};void 1", f"ExpressionStatement,UnaryExpression,typeof,Identifier,F0,ExpressionStatement,UnaryExpression,delete,MemberExpression,Identifier,F0,Identifier,b,ExpressionStatement,UnaryExpression,-,{_NUM},ExpressionStatement,UnaryExpression,void,NumericLiteral,N:1"),
        "update": ("a++;--b.c;f({n})", f"ExpressionStatement,UpdateExpression,++,Identifier,F0,ExpressionStatement,UpdateExpression,--,MemberExpression,Identifier,F1,Identifier,c,ExpressionStatement,{_F2}"),
        "new.target": ("function g(){return new.target}f({n})", f"FunctionDeclaration,Identifier,L0,BlockStatement,ReturnStatement,MetaProperty,Identifier,new,Identifier,target,{_X}"),
        "import": ('import("m",o);f({n})', f"ExpressionStatement,ImportExpression,StringLiteral,S:m,{_X}"),
        "parentheses": ("((f)(({n})))", _X),
        "sequence": ("a,b,f({n})", f"ExpressionStatement,SequenceExpression,Identifier,F0,Identifier,F1,{_F2}"),
        "assignment": ("a+={n};b.c=d", f"ExpressionStatement,AssignmentExpression,+=,Identifier,F0,{_NUM},{_SET}MemberExpression,Identifier,F1,Identifier,c,Identifier,F2"),
        "binary and logical": ("(a&&b)||c*{n};a??{n}", f"ExpressionStatement,LogicalExpression,||,LogicalExpression,&&,Identifier,F0,Identifier,F1,BinaryExpression,*,Identifier,F2,{_NUM},ExpressionStatement,LogicalExpression,??,Identifier,F0,{_NUM}"),
        "conditional": ("a?b:{n}", f"ExpressionStatement,ConditionalExpression,Identifier,F0,Identifier,F1,{_NUM}"),
        "new": ("new A(...b,{n});new A", f"ExpressionStatement,NewExpression,Identifier,F0,SpreadElement,Identifier,F1,{_NUM},ExpressionStatement,NewExpression,Identifier,F0"),
        "members": ('a["b"][c][{n}]', f"ExpressionStatement,MemberExpression,MemberExpression,MemberExpression,Identifier,F0,Identifier,b,Identifier,F1,{_NUM}"),
        "optional call": ("a?.b.c({n})", f"ExpressionStatement,OptionalCallExpression,MemberExpression,MemberExpression,Identifier,F0,Identifier,b,Identifier,c,{_NUM}"),
        "optional member": ("a?.[{n}]", f"ExpressionStatement,OptionalMemberExpression,Identifier,F0,{_NUM}"),
    },
    "patterns": {
        "object": ("var {a,b:c,...r}=o;f({n})", f"{_VAR}ObjectPattern,ObjectProperty,Identifier,a,Identifier,L0,ObjectProperty,Identifier,b,Identifier,L1,RestElement,Identifier,L2,Identifier,F0,ExpressionStatement,{_F1}"),
        "array": ("var [a,,b={n},...c]=o", f"{_VAR}ArrayPattern,Identifier,L0,AssignmentPattern,Identifier,L1,{_NUM},RestElement,Identifier,L2,Identifier,F0"),
        "default in object": ("var {a={n}}=o", f"{_VAR}ObjectPattern,ObjectProperty,Identifier,a,AssignmentPattern,Identifier,L0,{_NUM},Identifier,F0"),
        "array target": ("[a.b,c={n},...d]=o", f"{_SET}ArrayPattern,MemberExpression,Identifier,F0,Identifier,b,AssignmentPattern,Identifier,F1,{_NUM},RestElement,Identifier,F2,Identifier,F3"),
        "object target": ("({a,b={n},c:d}=o)", f"{_SET}ObjectPattern,ObjectProperty,Identifier,F0,ObjectProperty,Identifier,F1,AssignmentPattern,Identifier,F1,{_NUM},ObjectProperty,Identifier,c,Identifier,F2,Identifier,F3"),
    },
    "modules": {
        "import": ('import a,{b as c,"s" as e} from "m";import * as d from "k";f({n})', f"ImportDeclaration,ImportDefaultSpecifier,Identifier,L0,ImportSpecifier,Identifier,b,Identifier,L1,ImportSpecifier,StringLiteral,S:s,Identifier,L2,StringLiteral,S:m,ImportDeclaration,ImportNamespaceSpecifier,Identifier,L3,StringLiteral,S:k,{_X}"),
        "export": ('export const a={n};export{a as b};export{x as y}from"m";export*from"k";export*as z from"q"', f"ExportNamedDeclaration,{_VAR}Identifier,L0,{_NUM},ExportNamedDeclaration,ExportSpecifier,Identifier,L0,Identifier,b,ExportNamedDeclaration,ExportSpecifier,Identifier,x,Identifier,y,StringLiteral,S:m,ExportAllDeclaration,StringLiteral,S:k,ExportAllDeclaration,StringLiteral,S:q"),
        "default function": ("export default function(){return {n}}", f"ExportDefaultDeclaration,FunctionDeclaration,BlockStatement,ReturnStatement,{_NUM}"),
        "default class": ("export default class{a={n}}", f"ExportDefaultDeclaration,ClassDeclaration,ClassBody,ClassProperty,Identifier,a,{_NUM}"),
        "default value": ("export default {n}", f"ExportDefaultDeclaration,{_NUM}"),
        "import.meta": ("import.meta.url;f({n})", f"ExpressionStatement,MemberExpression,MetaProperty,Identifier,import,Identifier,meta,Identifier,url,{_X}"),
    },
}

#: Name -> (body of a function, statements, units).
UNITS: dict[str, tuple[str, int, int]] = {
    "nothing": ("", 0, 0), "block": ("{a();{b()}}", 1, 4), "call": ("f({n})", 1, 2), "call with spread": ("f(g(),...h())", 1, 3),
    "return": ("return a.b", 1, 2), "throw": ("throw f()", 1, 2), "declaration": ("var a=f(),b,c=g()", 1, 3), "if": ("if(a())b();else c()", 1, 6),
    "for": ("for(var i=0;i<{n};i++)f()", 1, 6), "for without parts": ("for(;;);", 1, 2), "for in": ("for(a.b in c)d()", 1, 4), "for of": ("for(var a of b())c()", 1, 5),
    "while": ("while(a())b()", 1, 4), "do while": ("do a();while(b())", 1, 4), "try": ("try{a()}catch(e){b()}finally{c()}", 1, 7),
    "switch": ("switch(a()){case b():c();default:d()}", 1, 7), "label": ("x:for(;;)break x", 1, 3), "with": ("with(a())b()", 1, 4),
    "function": ("function g(){a()}", 1, 3), "class": ("class A{m(){a()}p=b();static{c()}}", 1, 10), "break and more": ("debugger;;", 2, 2),
    "literals": ("this;1;null", 3, 3), "function value": ("x=function(){a()}", 1, 5), "arrow": ("x=()=>a()", 1, 4), "arrow with block": ("x=()=>{a()}", 1, 5),
    "members": ("a.b[c.d]", 1, 4), "new": ("new A(b())", 1, 3), "assignment": ("a.b=c()", 1, 4), "operators": ("a()+(b()&&c)?d():(e(),f)", 1, 9),
    "unary": ("!a();f(-b)", 2, 6), "update": ("a.b.c++", 1, 2), "array": ("[a(),,...b()]", 1, 3), "object": ("({a:b(),c,...d()})", 1, 7),
    "template": ("`x${a()}`", 1, 3), "tagged": ("t`x${a()}`", 1, 3), "import": ("import(a())", 1, 3), "chain": ("a?.b()", 1, 4),
    "array target": ("[a.b,c=d()]=e", 1, 6), "object target": ("({a:b.c,d=e()}=f)", 1, 8),
}

#: Name -> (source, names of the roots in order; an empty name is none).
TRAVERSAL: dict[str, tuple[str, list[str]]] = {
    "function": ("function a(x=function no(){}){function b(){}}", ["a", "b"]),
    "arrow": ("(x=function no(){})=>{function a(){}};y=>function b(){}", ["", "a", "b"]),
    "class": ("class A extends function(){}{m(){function a(){}}p=function no(){};static{function no(){}}}", ["A", "", "a"]),
    "declaration": ("var a=function b(){},{c=function no(){}}=d", ["b"]),
    "statements": ("(function a(){});{(function b(){})}x:(function c(){})", ["a", "b", "c"]),
    "return and throw": ("return function a(){};throw function b(){}", ["a", "b"]),
    "if": ("if(function a(){})(function b(){});else (function c(){})", ["a", "b", "c"]),
    "for": ("for(x=function a(){};function b(){};y=function c(){})(function d(){})", ["a", "b", "c", "d"]),
    "while": ("while(function no(){})(function a(){});do (function b(){});while(function no(){})", ["a", "b"]),
    "for in and of": ("for(x[function no(){}] in function a(){})(function b(){});for(var y of function c(){})(function d(){})", ["a", "b", "c", "d"]),
    "try": ("try{(function a(){})}catch({x=function no(){}}){(function b(){})}finally{(function c(){})}", ["a", "b", "c"]),
    "switch": ("switch(function no(){}){case function no(){}:(function a(){})}", ["a"]),
    "with": ("with(function no(){})(function no(){})", []),
    "export": ("export function a(){}export var b=function c(){};export default function d(){}", ["a", "c", "d"]),
    "object": ("x={m(){function a(){}},get g(){},[function no(){}]:function b(){},...function c(){}}", ["", "a", "", "b", "c"]),
    "call and new": ("(function a(){})(function b(){},...function no(){});new (function c(){})(function d(){})", ["a", "b", "c", "d"]),
    "assignment": ("x[function no(){}]=function a(){}", ["a"]),
    "operators": ("(function a(){}),(function b(){})?function c(){}:-function d(){}||1+function e(){}", ["a", "b", "c", "d", "e"]),
    "await and yield": ("async function*a(){await function b(){};yield function c(){}}", ["a", "b", "c"]),
    "array": ("[function a(){},...function no(){}]", ["a"]),
    "members": ("(function a(){}).x;(function b(){})[function c(){}]", ["a", "b", "c"]),
    "chain": ("(function a(){})?.x(function b(){})", ["a", "b"]),
    "templates": ("`${function a(){}}`;(function b(){})`${function c(){}}`;import(function d(){},function no(){})", ["a", "b", "c", "d"]),
    "update": ("x[function no(){}]++", []),
}


def _sources(spark: SparkSession, sf_dir: str, cases: dict[str, str]) -> DataFrame:
    """(case, n, source): each case for each number in part."""
    sizes = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_size").alias("n")).distinct()
    rows = F.array(*[F.struct(F.lit(name).alias("case"), F.lit(source).alias("source")) for name, source in cases.items()])
    return sizes.select("n", F.explode(rows).alias("c")).select("c.case", "n", F.replace("c.source", F.lit("{n}"), F.col("n").cast("string")).alias("source"))


def _stream_query(group: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = an.extract_hashes(_sources(spark, sf_dir, {k: v[0] for k, v in STREAMS[group].items()}))
        return found.select("case", "n", "file_hash", F.col("error").isNull().alias("parsed"))

    return query


def _values(rows: list[tuple], names: str) -> str:
    quote = lambda x: str(x) if isinstance(x, int) else "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) t({names})"


def _sql(rows: list[tuple], names: str, what: str) -> str:
    return f"SELECT t.\"case\", p.n, {what} FROM (SELECT DISTINCT p_size AS n FROM part) p, {_values(rows, names)}"


def syntax_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    scripts = _sources(spark, sf_dir, {k: "function outer(){" + v[0] + "}" for k, v in UNITS.items()})
    found = an.functions_of(an.extract_hashes(scripts, 0), ["case", "n"])
    return found.filter("seq = 0").select("case", "n", "stmt_count", "units")


def syntax_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = an.functions_of(an.extract_hashes(_sources(spark, sf_dir, {k: v[0] for k, v in TRAVERSAL.items()}), 0), ["case", "n"])
    return found.select("case", "n", "seq", F.coalesce("name", F.lit("")).alias("name"))


#: Name -> (source with one root, its stream, its name).
ROOTS: dict[str, tuple[str, str, str]] = {
    "function": ('function a(x,y="p,q"){f(x,{n});return y}', rf"Identifier,L0,AssignmentPattern,Identifier,L1,StringLiteral,S:p\,q,BlockStatement,{_CALL}F0,Identifier,L0,{_NUM},ReturnStatement,Identifier,L1", "a"),
    "arrow": ("x=(y,z)=>{f(y,{n})}", f"Identifier,L0,Identifier,L1,CallExpression,Identifier,F0,Identifier,L0,{_NUM}", ""),
    "class": ("class A extends B{p={n}}", f"Identifier,F0,ClassBody,ClassProperty,Identifier,p,{_NUM}", "A"),
}


def syntax_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and canonical texts of roots, and of the program around them."""
    found = an.extract_detailed_hashes(_sources(spark, sf_dir, {k: v[0] for k, v in ROOTS.items()}), 0)
    roots = an.functions_of(found.select("case", "n", "functions"), ["case", "n"])
    return roots.select("case", "n", "hash", "canonical", F.coalesce("name", F.lit("")).alias("name"))


def syntax_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that can't be parsed have an error, no digest and no roots."""
    bad = {"cut off": "function f({n}", "no name": "var = {n}", "stray bracket": "f({n}))", "open string": 'f("{n}', "open comment": "/* {n}", "fine": "f({n})"}
    found = an.extract_hashes(_sources(spark, sf_dir, bad), 0)
    return found.select("case", "n", (F.col("error").isNotNull()).alias("failed"), F.col("file_hash").isNull().alias("no_hash"), F.size("functions").cast("long").alias("roots"))


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file_hash(source)`` and ``tokens(source)`` as SQL calls them."""
    an.register(spark)
    view = "quillmark_sources"
    _sources(spark, sf_dir, {k: v[0] for k, v in STREAMS["literals"].items()}).createOrReplaceTempView(view)
    return spark.sql(f"SELECT s.`case`, s.n, file_hash(s.source) AS hash, t.tokens FROM {view} s JOIN (SELECT `case`, n, count(*) AS tokens FROM {view}, LATERAL tokens(source) GROUP BY `case`, n) t ON s.`case` = t.`case` AND s.n = t.n")


QUERIES = {f"syntax_{g}": _stream_query(g) for g in STREAMS} | {
    "syntax_units": syntax_units,
    "syntax_traversal": syntax_traversal,
    "syntax_roots": syntax_roots,
    "syntax_errors": syntax_errors,
    "sql_functions": sql_functions,
}

_DIGEST = f"'{PREFIX}' || sha256(replace({{}}, '{{{{n}}}}', CAST(p.n AS VARCHAR)))"
_PLAIN = r"replace(replace(replace(t.stream, '\,', ','), '\\', '\'), '{n}', CAST(p.n AS VARCHAR))"
#: Commas of a stream that part tokens, not the escaped ones.
_SEPARATORS = r"CAST(len(t.stream) - len(replace(replace(t.stream, '\,', ''), ',', '')) - (len(t.stream) - len(replace(t.stream, '\,', ''))) + 1 AS BIGINT)"

ORACLE_SQL = {f"syntax_{g}": _sql([(k, "Program," + v[1]) for k, v in cases.items()], '"case", stream', f"{_DIGEST.format('t.stream')} AS file_hash, true AS parsed") for g, cases in STREAMS.items()} | {
    "syntax_units": _sql([(k, v[1], v[2]) for k, v in UNITS.items()], '"case", stmts, units', "CAST(t.stmts AS BIGINT) AS stmt_count, CAST(t.units AS BIGINT) AS units"),
    "syntax_traversal": _sql([(k, i, name) for k, v in TRAVERSAL.items() for i, name in enumerate(v[1])], '"case", seq, name', "t.seq, t.name"),
    "syntax_roots": _sql([(k, v[1], v[2]) for k, v in ROOTS.items()], '"case", stream, name', f"{_DIGEST.format('t.stream')} AS hash, {_PLAIN} AS canonical, t.name"),
    "syntax_errors": _sql([(k, 1) for k in ("cut off", "no name", "stray bracket", "open string", "open comment")] + [("fine", 0)], '"case", bad', "t.bad = 1 AS failed, t.bad = 1 AS no_hash, CAST(0 AS BIGINT) AS roots"),
    "sql_functions": _sql([(k, "Program," + v[1]) for k, v in STREAMS["literals"].items()], '"case", stream', f"{_DIGEST.format('t.stream')} AS hash, {_SEPARATORS} AS tokens"),
}
