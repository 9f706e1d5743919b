"""JavaScript modules and TypeScript."""

from __future__ import annotations

import re
from collections.abc import Callable

from lodeseam.llm.grammars.base import END, Function, Kinds, Parser, Refused, Source, named_functions, number, table

_SPACE = r"[\s﻿]+"
_COMMENT = r"//[^\n  ]*|/\*(?s:.*?)\*/"
_TOKEN = re.compile(
    rf"((?:{_SPACE}|{_COMMENT})*)"
    r"([^\W\d][$\w\\]*|[$\\][$\w\\]*|0[xXbBoO]\w+|[0-9]\w*(?:\.\w*)?(?:(?<=[eE])[+-]\w+)?|[()\[\]{};,:~@#]|\.\.\.|\.[0-9][\w.]*(?:(?<=[eE])[+-]?\w+)?|\.|=>|===?|=|!==?|!|\?\?=?|\?\.(?![0-9])|\?|&&=?|&=?|\|\|=?|\|=?|\+\+|\+=?|--|-=?|\*\*=?|\*=?|%=?|\^=?|<<=|<<|<=|<|>>>=|>>=|>=|>"
    r"|/=?|\"(?:[^\"\\\n]|\\(?s:.))*\"|'(?:[^'\\\n]|\\(?s:.))*'|`|\Z|(?s:.))"
)
_COMMENTS = re.compile(_COMMENT).finditer
_REGEX = re.compile(r"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[a-zA-Z]*")
_TEMPLATE = re.compile(r"(?:\\(?s:.)|\$(?!\{)|[^`\\$])*")
_NUMBER = number(
    r"(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*|0[bB][01](?:_?[01])*|0[oO][0-7](?:_?[0-7])*|(?:0|[1-9](?:_?[0-9])*))n?"
    r"|(?:(?:0|[1-9](?:_?[0-9])*)(?:\.(?:[0-9](?:_?[0-9])*)?)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?"
)
_WORDS = (
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with "
    "yield let static await async of get set from as implements interface package private protected public "
    "type declare namespace module abstract readonly is keyof infer asserts unique override satisfies accessor global target meta"
)
_MARKS = "( ) [ ] { } ; , : ~ @ # ... . => == === = != !== ! ?? ??= ?. ? && &&= & &= || ||= | |= ++ + += -- - -= ** **= * *= % %= ^ ^= <<= << <= < >>>= >>= >= > / /="


def _classify(text: str) -> str:
    c = text[0]
    if c.isdigit() or (c == "." and len(text) > 1):
        return "NUM" if _NUMBER(text) else "?!"
    if c in "\"'":
        return "STR" if len(text) > 1 else "?!"
    if c in "_$" or c.isalpha():
        return "ID" if "\\" not in text else "?!"
    if c == "\\":
        return "ID" if re.fullmatch(r"(?:\\u[0-9a-fA-F]{4}|[\w$])+", text) else "?!"
    return "?!"


_KINDS = Kinds(table(_WORDS, _MARKS) | {"true": "LIT", "false": "LIT", "null": "LIT"}, _classify)
#: Behind these a slash divides; behind anything else it opens a regular expression.
_VALUES = frozenset("ID NUM STR LIT TPL TT REGEX ) ] } this super ++ -- async of get set from as type declare namespace module abstract readonly is keyof infer asserts unique override satisfies accessor global target meta let static".split())
_HEADS = frozenset("if while for with".split())
#: Behind these an opening brace is an object, and a slash behind its closing brace divides.
_OPERATORS = frozenset("( , = : [ ! & | ? { } ; + - * / % ^ ~ < > => == === != !== ?? && || += -= *= ??= &&= ||= ... return typeof case in of instanceof new delete void throw yield await default".split()) - frozenset("{ } ; =>".split())


def lex(text: str, places: Source | None = None) -> tuple[list[str], bytearray]:
    """(kinds, whether a line ends before each); a kind "?!" is no token.

    Templates give TPL, or TH (TM)* TT around the tokens of their holes. Offsets and comments go to ``places``.
    """
    kinds: list[str] = []
    lines = bytearray()
    holes: list[int] = []  # depth of braces at each open hole of a template
    parens: list[bool] = []
    braces: list[bool] = []
    depth = 0
    at = 2 if text.startswith("#!") else 0
    if at:
        at = text.find("\n") if "\n" in text else len(text)
    last = ""
    slash_divides = False
    match, get = _TOKEN.match, _KINDS.__getitem__
    while True:
        m = match(text, at)
        blank, token = m.groups()
        start, at = m.start(2), m.end()
        if places and "/" in blank:
            places.comments.extend((m.start() + c.start(), m.start() + c.end()) for c in _COMMENTS(blank))
        if not token:
            break
        if token == "`" or (token == "}" and holes and holes[-1] == depth):
            body = _TEMPLATE.match(text, at)
            at = body.end()
            head = token == "`"
            if not head:
                holes.pop()
            if text.startswith("`", at):
                kind = "TPL" if head else "TT"
                at += 1
            elif text.startswith("${", at):
                kind = "TH" if head else "TM"
                at += 2
                holes.append(depth)
            else:
                kind = "?!"
            slash_divides = kind in ("TPL", "TT")
        else:
            kind = get(token)
            if kind == "/" or kind == "/=":
                if not slash_divides:
                    found = _REGEX.match(text, start)
                    if found:
                        kind, at = "REGEX", found.end()
                slash_divides = kind == "REGEX"
            elif kind == "(":
                parens.append(last in _HEADS)
                slash_divides = False
            elif kind == ")":
                slash_divides = not (parens and parens.pop())
            elif kind == "{":
                depth += 1
                braces.append(last in _OPERATORS)
                slash_divides = False
            elif kind == "}":
                depth -= 1
                slash_divides = bool(braces and braces.pop())
            else:
                slash_divides = kind in _VALUES or (last == "." and kind in _KINDS.fixed)
        kinds.append(kind)
        lines.append(1 if blank and "\n" in blank else 0)
        if places:
            places.starts.append(start)
            places.ends.append(at)
        last = kind
    if places:
        places.kinds.extend(kinds)
    return kinds, lines


_RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends LIT finally for function if import in instanceof new return super switch this throw try typeof var void while with".split()
)
_STRICT = frozenset("yield let static implements interface package private protected public await".split())
_SOFT = frozenset("async of get set from as type declare namespace module abstract readonly is keyof infer asserts unique override satisfies accessor global target meta".split())
_NAMES = frozenset(("ID",)) | _SOFT
_WORD = _NAMES | _RESERVED | _STRICT
_KEYS = _WORD | frozenset(("STR", "NUM"))
_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= **= <<= >>= >>>= &&= ||= ??=".split())
_BINARY = frozenset("+ - * / % & | ^ && || == === != !== < <= >= << ?? ** instanceof".split())
_PREFIX = frozenset("! ~ + - typeof void delete".split())
_MEMBER_END = frozenset("( = ; , } : ? ! <".split()) | {END}
_TS_MODIFIERS = frozenset("public private protected readonly abstract override declare accessor static async".split())
_NO_TYPE_ARGUMENTS = frozenset("ID NUM STR LIT TPL REGEX [ { ! ~ + - ++ -- new this super function class < > typeof void delete # async".split())
VALUE, TARGET, PATTERN = 0, 1, 2


class _Script(Parser):
    def __init__(self, kinds: list[str], lines: bytearray, ts: bool):
        super().__init__(kinds)
        lines.append(1)
        self.nl, self.ts = lines, ts
        self.function = self.generator = False
        self.asynchronous = True  # a module's top level may await
        self.loops = self.breaks = 0
        self.no_in = False
        self.no_conditional = False
        self.in_conditional = False
        self.ambient = False

    def name(self) -> None:
        self.take_in(_NAMES)

    def semi(self) -> None:
        t = self.k[self.p]
        if t == ";":
            self.p += 1
        elif t != "}" and t != END and not self.nl[self.p]:
            self.fail()

    # ---- statements

    def program(self) -> None:
        k = self.k
        while k[self.p] != END:
            self.item(True)

    def item(self, top: bool = False) -> None:
        """A statement or a declaration."""
        k = self.k
        t = k[self.p]
        if t in ("import", "export", "@", "class", "const", "let", "function", "async", "enum", "type", "interface", "namespace", "module", "declare", "abstract", "global"):
            if t == "class":
                self.klass(True)
                return
            if t == "const" and not (self.ts and k[self.p + 1] == "enum") or t == "let":
                self.variables(self.p)
                self.semi()
                return
            if t == "function" or (t == "async" and k[self.p + 1] == "function" and not self.nl[self.p + 1]):
                self.function_(self.p)
                return
            if t == "@":
                self.decorators()
                if k[self.p] == "export" and top:
                    self.export()
                else:
                    if self.ts:
                        self.has("abstract")
                    self.klass(True)
                return
            if t == "import" and k[self.p + 1] not in ("(", "."):
                if not top:
                    self.fail()
                self.import_()
                return
            if t == "export":
                if not top:
                    self.fail()
                self.export()
                return
            if self.ts and self.ts_declaration(top):
                return
        self.statement()

    def block(self) -> None:
        self.take("{")
        close = self.match[self.p - 1]
        while self.p < close:
            self.item()
        self.p += 1

    def statement(self) -> None:
        k = self.k
        rule = _STATEMENTS.get(k[self.p])
        if rule is not None:
            rule(self)
            return
        if k[self.p] in _NAMES and k[self.p + 1] == ":":
            self.p += 2
            before, self.breaks = self.breaks, self.breaks + 1
            if k[self.p] == "function":
                self.fail()
            self.statement()
            self.breaks = before
            return
        if k[self.p] in ("function", "class", "const") or (k[self.p] == "async" and k[self.p + 1] == "function" and not self.nl[self.p + 1]):
            self.fail()
        self.sequence()
        self.semi()

    def condition(self) -> None:
        self.take("(")
        before, self.no_in = self.no_in, False
        self.sequence()
        self.no_in = before
        self.take(")")

    def _var(self) -> None:
        self.variables(self.p)
        self.semi()

    def variables(self, first: int) -> None:
        """Declarations of variables; ``first`` is the token that the whole statement begins with."""
        kind = self.k[self.p]
        self.p += 1
        while True:
            name = self.p
            pattern = self.k[self.p] in ("{", "[")
            self.target()
            if self.ts:
                if self.k[self.p] == "!" and self.k[self.p + 1] == ":":
                    self.p += 1
                if self.has(":"):
                    self.type()
            if self.has("="):
                function = not pattern and self.function_ahead()
                self.assign()
                if function:
                    self.note(name, first)
            elif (pattern or (kind == "const" and not self.ts)) and not self.ambient:
                self.fail()
            if not self.has(","):
                return
            first = self.p

    def function_ahead(self) -> bool:
        """Whether a function or an arrow function stands here."""
        k, p = self.k, self.p
        if k[p] == "async" and not self.nl[p + 1] and k[p + 1] != "=>":
            p += 1
        if k[p] == "function":
            return True
        if k[p] in _NAMES:
            return k[p + 1] == "=>"
        if self.ts and k[p] == "<":
            while k[p] not in ("(", ";", END):
                p += 1
        return k[p] == "(" and (k[self.match[p] + 1] == "=>" or (self.ts and k[self.match[p] + 1] == ":"))

    def _if(self) -> None:
        while True:
            self.p += 1
            self.condition()
            self.statement()
            if not self.has("else"):
                return
            if self.k[self.p] != "if":
                self.statement()
                return

    def body_of_loop(self) -> None:
        self.loops += 1
        self.statement()
        self.loops -= 1

    def _while(self) -> None:
        self.p += 1
        self.condition()
        self.body_of_loop()

    def _do(self) -> None:
        self.p += 1
        self.body_of_loop()
        self.take("while")
        self.condition()
        self.has(";")

    def _for(self) -> None:
        k = self.k
        self.p += 1
        waits = self.has("await")
        self.take("(")
        close = self.match[self.p - 1]
        t = k[self.p]
        self.no_in = True
        looped = False
        if t in ("var", "let", "const"):
            start = self.p
            self.p += 1
            self.target()
            if self.ts and self.has(":"):
                self.type()
            if k[self.p] in ("of", "in"):
                looped = True
            else:
                self.p = start
                self.variables(start)
        elif t != ";":
            if t in "{[" and t and k[self.match[self.p] + 1] in ("of", "in"):
                self.target(True)
                looped = True
            else:
                kind = self.sequence()
                looped = k[self.p] in ("of", "in")
                if looped and kind != TARGET:
                    self.fail()
        self.no_in = False
        if looped:
            if self.has("of"):
                self.assign()
            else:
                if waits:
                    self.fail()
                self.p += 1
                self.sequence()
        else:
            if waits:
                self.fail()
            self.take(";")
            if k[self.p] != ";":
                self.sequence()
            self.take(";")
            if self.p < close:
                self.sequence()
        if self.p != close:
            self.fail()
        self.p += 1
        self.body_of_loop()

    def _switch(self) -> None:
        self.p += 1
        self.condition()
        self.take("{")
        k, close = self.k, self.match[self.p - 1]
        self.breaks += 1
        while self.p < close:
            if not self.has("default"):
                self.take("case")
                self.sequence()
            self.take(":")
            while self.p < close and k[self.p] not in ("case", "default"):
                self.item()
        self.breaks -= 1
        self.p += 1

    def _try(self) -> None:
        self.p += 1
        self.block()
        found = False
        if self.has("catch"):
            found = True
            if self.has("("):
                self.target()
                if self.ts and self.has(":"):
                    self.type()
                self.take(")")
            self.block()
        if self.has("finally"):
            found = True
            self.block()
        if not found:
            self.fail()

    def _return(self) -> None:
        if not self.function:
            self.fail()
        self.p += 1
        if self.k[self.p] not in (";", "}", END) and not self.nl[self.p]:
            self.sequence()
        self.semi()

    def _throw(self) -> None:
        self.p += 1
        if self.nl[self.p]:
            self.fail()
        self.sequence()
        self.semi()

    def _jump(self) -> None:
        kind = self.k[self.p]
        self.p += 1
        if self.k[self.p] in _NAMES and not self.nl[self.p]:
            self.p += 1
        elif not self.loops and not (kind == "break" and self.breaks):
            self.fail()
        self.semi()

    def _debugger(self) -> None:
        self.p += 1
        self.semi()

    def _empty(self) -> None:
        self.p += 1

    # ---- modules

    def import_(self) -> None:
        k = self.k
        self.p += 1
        if self.has("STR"):
            self.attributes()
            return
        if self.ts and k[self.p] == "type" and (k[self.p + 1] in ("{", "*") or (k[self.p + 1] in _NAMES and (k[self.p + 1] != "from" or k[self.p + 2] == "from"))):
            self.p += 1
        if k[self.p] in _NAMES:
            self.p += 1
            if self.ts and self.has("="):
                if k[self.p] in _NAMES and k[self.p + 1] == "(":
                    self.p += 2
                    self.take("STR")
                    self.take(")")
                else:
                    self.name()
                    while self.has("."):
                        self.take_in(_WORD)
                self.semi()
                return
            if not self.has(","):
                self.take("from")
                self.take("STR")
                self.attributes()
                return
        if self.has("*"):
            self.take("as")
            self.name()
        else:
            self.specifiers(True)
        self.take("from")
        self.take("STR")
        self.attributes()

    def attributes(self) -> None:
        if self.k[self.p] in ("with", "ID") and self.k[self.p + 1] == "{" and not self.nl[self.p]:
            self.p += 2
            self.all_in(self.match[self.p - 1], self.attribute)
        self.semi()

    def attribute(self) -> None:
        self.take_in(_KEYS)
        self.take(":")
        self.take("STR")

    def specifiers(self, importing: bool) -> None:
        self.take("{")
        self.all_in(self.match[self.p - 1], self.imported if importing else self.exported)

    def imported(self) -> None:
        k = self.k
        if self.ts and k[self.p] == "type" and (k[self.p + 1] in _KEYS) and not (k[self.p + 1] == "as" and k[self.p + 2] not in ("as", ",", "}")):
            self.p += 1
        if k[self.p + 1] == "as":
            self.take_in(_KEYS)
            self.p += 1
        self.name()

    def exported(self) -> None:
        k = self.k
        if self.ts and k[self.p] == "type" and (k[self.p + 1] in _KEYS) and not (k[self.p + 1] == "as" and k[self.p + 2] not in ("as", ",", "}")):
            self.p += 1
        self.take_in(_KEYS)
        if self.has("as"):
            self.take_in(_KEYS)

    def export(self) -> None:
        k, first = self.k, self.p
        self.p += 1
        t = k[self.p]
        if t == "default":
            self.p += 1
            t = k[self.p]
            if t == "function" or (t == "async" and k[self.p + 1] == "function" and not self.nl[self.p + 1]):
                self.function_(first, nameless=True)
            elif t == "class" or t == "@":
                self.decorators()
                if self.ts:
                    self.has("abstract")
                self.klass(True, nameless=True)
            elif self.ts and t == "abstract" and k[self.p + 1] == "class":
                self.p += 1
                self.klass(True, nameless=True)
            elif self.ts and t == "interface":
                self.interface()
            else:
                self.assign()
                self.semi()
            return
        if t == "*":
            self.p += 1
            if self.has("as"):
                self.take_in(_KEYS)
            self.take("from")
            self.take("STR")
            self.attributes()
            return
        if t == "{" or (self.ts and t == "type" and k[self.p + 1] in ("{", "*")):
            if t == "type":
                self.p += 1
            if self.has("*"):
                if self.has("as"):
                    self.take_in(_KEYS)
                self.take("from")
                self.take("STR")
                self.attributes()
                return
            self.specifiers(False)
            if self.has("from"):
                self.take("STR")
                self.attributes()
            else:
                self.semi()
            return
        if self.ts:
            if t == "=":
                self.p += 1
                self.assign()
                self.semi()
                return
            if t == "as" and k[self.p + 1] == "namespace":
                self.p += 2
                self.name()
                self.semi()
                return
            if t == "import":
                self.import_()
                return
        if t in ("var", "let") or (t == "const" and not (self.ts and k[self.p + 1] == "enum")):
            self.variables(first)
            self.semi()
        elif t == "class" or t == "@":
            self.decorators()
            if self.ts:
                self.has("abstract")
            self.klass(True)
        elif t == "function" or (t == "async" and k[self.p + 1] == "function"):
            self.function_(first)
        elif not (self.ts and self.ts_declaration(True)):
            self.fail()

    # ---- functions and classes

    def decorators(self) -> None:
        k = self.k
        while self.has("@"):
            if k[self.p] == "(":
                self.parenthesised()
                continue
            self.name()
            while k[self.p] == "." and (k[self.p + 1] in _WORD or k[self.p + 1] == "#"):
                self.p += 3 if k[self.p + 1] == "#" else 2
            if self.ts and k[self.p] == "<":
                self.type_arguments()
            if k[self.p] == "(":
                self.arguments()

    def function_(self, first: int | None, nameless: bool = False) -> None:
        """A declaration that begins with the token ``first``, or an expression."""
        asynchronous = self.has("async")
        self.take("function")
        generator = self.has("*")
        declared = first is not None
        name = self.p
        if declared:
            if not nameless or self.k[self.p] != "(" and self.k[self.p] != "<":
                self.name()
        elif self.k[self.p] in _NAMES or self.k[self.p] in ("yield", "await"):
            self.p += 1
        named = declared and self.p > name
        self.signature_and_body(asynchronous, generator, bodiless=declared and self.ts)
        if named:
            self.found.append((name, first, self.p))

    def signature_and_body(self, asynchronous: bool, generator: bool, bodiless: bool = False) -> None:
        outer = self.function, self.asynchronous, self.generator, self.loops, self.breaks, self.no_in, self.in_conditional
        self.function, self.asynchronous, self.generator, self.loops, self.breaks, self.no_in, self.in_conditional = True, asynchronous, generator, 0, 0, False, False
        if self.ts and self.k[self.p] == "<":
            self.type_parameters()
        self.parameters()
        if self.ts and self.has(":"):
            self.return_type()
        if self.k[self.p] == "{":
            self.block()
        elif bodiless:
            self.semi()
        else:
            self.fail()
        self.function, self.asynchronous, self.generator, self.loops, self.breaks, self.no_in, self.in_conditional = outer

    def parameters(self) -> None:
        self.take("(")
        self.all_in(self.match[self.p - 1], self.parameter)

    def parameter(self) -> None:
        k = self.k
        if self.ts:
            if k[self.p] == "@":
                self.decorators()
            while k[self.p] in ("public", "private", "protected", "readonly", "override") and k[self.p + 1] not in (",", ")", ":", "=", "?"):
                self.p += 1
            if k[self.p] == "this" and k[self.p + 1] in (":", ",", ")"):
                self.p += 1
                if self.has(":"):
                    self.type()
                return
        rest = self.has("...")
        self.target()
        if self.ts:
            self.has("?")
            if self.has(":"):
                self.type()
        if rest:
            if k[self.p] != ")":
                self.fail()
        elif self.has("="):
            self.assign()

    def target(self, assigning: bool = False) -> None:
        """A binding, or, when assigning, what may stand left of an equals sign."""
        t = self.k[self.p]
        if t == "{":
            self.p += 1
            close = self.match[self.p - 1]
            self.all_in(close, lambda: self.property_target(assigning, close))
        elif t == "[":
            self.p += 1
            close = self.match[self.p - 1]
            while self.p < close:
                if self.has(","):
                    continue
                rest = self.has("...")
                self.element_target(assigning, not rest)
                if self.p < close:
                    if rest:
                        self.fail()
                    self.take(",")
            self.p = close + 1
        elif assigning:
            if self.unary() != TARGET:
                self.fail()
        else:
            self.name()

    def element_target(self, assigning: bool, default: bool = True) -> None:
        self.nested(assigning)
        if default and self.has("="):
            before, self.no_in = self.no_in, False
            self.assign()
            self.no_in = before

    def nested(self, assigning: bool) -> None:
        k = self.k
        if assigning and k[self.p] in ("{", "[") and k[self.match[self.p] + 1] not in (",", "}", "]", "=", ")"):
            if self.unary() != TARGET:
                self.fail()
        else:
            self.target(assigning)

    def property_target(self, assigning: bool, close: int) -> None:
        k = self.k
        if self.has("..."):
            if assigning:
                if self.unary() != TARGET:
                    self.fail()
            else:
                self.name()
            if self.p != close:
                self.fail()
            return
        if k[self.p] in _NAMES and k[self.p + 1] in (",", "}", "="):
            self.p += 1
            if self.has("="):
                before, self.no_in = self.no_in, False
                self.assign()
                self.no_in = before
            return
        self.key(False)
        self.take(":")
        self.element_target(assigning)

    def key(self, private: bool) -> None:
        k = self.k
        t = k[self.p]
        if t in _KEYS:
            self.p += 1
        elif t == "[":
            self.p += 1
            before = self.no_in, self.in_conditional
            self.no_in = self.in_conditional = False
            self.assign()
            self.no_in, self.in_conditional = before
            self.take("]")
        elif t == "#" and private and k[self.p + 1] in _WORD:
            self.p += 2
        else:
            self.fail()

    def klass(self, declared: bool, nameless: bool = False) -> None:
        k = self.k
        self.take("class")
        if k[self.p] in _NAMES:
            self.p += 1
        elif declared and not nameless:
            self.fail()
        if self.ts and k[self.p] == "<":
            self.type_parameters()
        if self.has("extends"):
            self.heritage()
        if self.ts and self.has("implements"):
            self.type_list()
        self.take("{")
        close = self.match[self.p - 1]
        outer = self.no_in, self.in_conditional, self.loops, self.breaks
        self.no_in = self.in_conditional = False
        self.loops = self.breaks = 0
        while self.p < close:
            if not self.has(";"):
                self.member()
        self.no_in, self.in_conditional, self.loops, self.breaks = outer
        self.p += 1

    def heritage(self) -> None:
        self.postfix(no_object=True)
        if self.ts and self.k[self.p] == "<":
            self.type_arguments()

    def member(self) -> None:
        k, first = self.k, self.p
        ts = self.ts
        if k[self.p] == "@":
            self.decorators()
        if k[self.p] == "static" and k[self.p + 1] == "{":
            self.p += 1
            outer = self.function, self.asynchronous
            self.asynchronous = False
            self.block()
            self.function, self.asynchronous = outer
            return
        asynchronous = False
        if ts:
            while k[self.p] in _TS_MODIFIERS and k[self.p + 1] not in _MEMBER_END and not (self.nl[self.p + 1] and k[self.p] in ("async", "accessor", "declare", "abstract")):
                asynchronous = asynchronous or k[self.p] == "async"
                self.p += 1
            if k[self.p] == "[" and k[self.p + 1] in _NAMES and k[self.p + 2] == ":":
                self.index_signature()
                self.semi()
                return
        else:
            if k[self.p] == "static" and k[self.p + 1] not in _MEMBER_END:
                self.p += 1
            if k[self.p] == "async" and k[self.p + 1] not in _MEMBER_END and not self.nl[self.p + 1]:
                self.p += 1
                asynchronous = True
            elif k[self.p] == "accessor" and k[self.p + 1] not in _MEMBER_END and not self.nl[self.p + 1]:
                self.p += 1
        generator = self.has("*")
        if not generator and not asynchronous and k[self.p] in ("get", "set") and k[self.p + 1] not in _MEMBER_END and (k[self.p + 1] in _KEYS or k[self.p + 1] in ("[", "#")):
            self.p += 1
        name = self.p + 1 if k[self.p] == "#" else self.p
        self.key(True)
        named = self.p == name + 1 and k[name] in _WORD
        if ts:
            if not self.has("?"):
                self.has("!")
        if k[self.p] == "(" or (ts and k[self.p] == "<"):
            self.signature_and_body(asynchronous, generator, bodiless=ts)
            if named:
                self.found.append((name, first, self.p))
            return
        if generator or asynchronous:
            self.fail()
        if ts and self.has(":"):
            self.type()
        if self.has("="):
            outer = self.function, self.asynchronous
            self.asynchronous = False
            function = named and self.function_ahead()
            self.assign()
            if function:
                self.note(name, first)
            self.function, self.asynchronous = outer
        self.semi()

    # ---- expressions

    def sequence(self) -> int:
        kind = self.assign()
        while self.k[self.p] == ",":
            self.p += 1
            self.assign()
            kind = VALUE
        return kind

    def parenthesised(self) -> int:
        self.p += 1
        before = self.no_in, self.in_conditional
        self.no_in = self.in_conditional = False
        kind = self.sequence()
        self.no_in, self.in_conditional = before
        self.take(")")
        return TARGET if kind == TARGET else VALUE

    def arguments(self) -> None:
        self.p += 1
        before = self.no_in, self.in_conditional
        self.no_in = self.in_conditional = False
        self.all_in(self.match[self.p - 1], self.argument)
        self.no_in, self.in_conditional = before

    def argument(self) -> None:
        if self.k[self.p] == "...":
            self.p += 1
        self.assign()

    def arrow(self) -> bool:
        """An arrow function, if one stands here."""
        k = self.k
        p = self.p
        t = k[p]
        asynchronous = False
        if t == "async" and not self.nl[p + 1] and (k[p + 1] in _NAMES or k[p + 1] == "(" or (self.ts and k[p + 1] == "<")):
            if k[p + 1] in _NAMES and k[p + 2] != "=>":
                return False
            asynchronous = True
            p += 1
            t = k[p]
        if t in _NAMES:
            if k[p + 1] != "=>" or self.nl[p + 1]:
                return False
            self.p = p + 1
            self.arrow_body(asynchronous)
            return True
        if t == "(":
            after = k[self.match[p] + 1]
            if after == "=>":
                self.p = p
                self.arrow_parameters(asynchronous)
                self.arrow_body(asynchronous)
                return True
            if self.ts and after == ":":
                return self.speculative(p, asynchronous)
            return False
        if t == "<" and self.ts:
            return self.speculative(p, asynchronous)
        return False

    def speculative(self, p: int, asynchronous: bool) -> bool:
        start = self.p
        state = self.function, self.asynchronous, self.generator, self.loops, self.breaks, self.no_in, self.in_conditional, self.no_conditional

        def rule():
            self.p = p
            self.arrow_parameters(asynchronous)
            if self.k[self.p] != "=>":
                self.fail()
            conditional = self.in_conditional
            self.arrow_body(asynchronous)
            if conditional and self.k[self.p] != ":":
                self.fail()

        if self.tries(rule):
            return True
        self.p = start
        self.function, self.asynchronous, self.generator, self.loops, self.breaks, self.no_in, self.in_conditional, self.no_conditional = state
        return False

    def arrow_parameters(self, asynchronous: bool) -> None:
        outer = self.asynchronous, self.no_in, self.in_conditional
        self.asynchronous, self.no_in, self.in_conditional = asynchronous, False, False
        if self.ts and self.k[self.p] == "<":
            self.type_parameters()
        self.parameters()
        if self.ts and self.has(":"):
            self.return_type()
        self.asynchronous, self.no_in, self.in_conditional = outer

    def arrow_body(self, asynchronous: bool) -> None:
        self.take("=>")
        outer = self.function, self.asynchronous, self.generator, self.loops, self.breaks, self.no_in, self.in_conditional
        self.asynchronous, self.generator = asynchronous, False
        if self.k[self.p] == "{":
            self.function, self.loops, self.breaks, self.no_in, self.in_conditional = True, 0, 0, False, False
            self.block()
        else:
            self.assign()
        self.function, self.asynchronous, self.generator, self.loops, self.breaks, self.no_in, self.in_conditional = outer

    def assign(self) -> int:
        k, first = self.k, self.p
        t = k[first]
        if (t in _NAMES or t == "(" or t == "<") and self.arrow():
            return VALUE
        if (t == "{" or t == "[") and k[self.match[self.p] + 1] == "=":
            self.target(True)
            self.p += 1
            self.assign()
            return VALUE
        if t == "yield":
            if not self.generator:
                self.fail()
            self.p += 1
            if not self.nl[self.p]:
                if self.has("*"):
                    self.assign()
                elif k[self.p] not in (")", "]", "}", ",", ";", ":", END, "in", "of", "TM", "TT"):
                    self.assign()
            return VALUE
        kind = self.unary()
        while True:
            t = k[self.p]
            if t in _BINARY:
                self.p += 1
            elif t == ">":
                self.p += 1
                while k[self.p] == ">":
                    self.p += 1
            elif t == "in" and not self.no_in:
                self.p += 1
            elif t == "?":
                self.p += 1
                before = self.no_in, self.in_conditional
                self.no_in, self.in_conditional = False, True
                self.assign()
                self.no_in, self.in_conditional = before
                self.take(":")
                self.assign()
                return VALUE
            elif t in _ASSIGN:
                if kind != TARGET:
                    self.fail()
                name = self.p - 1
                self.p += 1
                function = t == "=" and k[name] in _WORD and self.function_ahead()
                self.assign()
                if function:
                    self.note(name, first)
                return VALUE
            elif self.ts and (t == "as" or t == "satisfies") and not self.nl[self.p]:
                self.p += 1
                if k[self.p] == "const":
                    self.p += 1
                else:
                    self.type()
                continue
            else:
                return kind
            if k[self.p] == "yield":
                self.fail()
            self.unary()
            kind = VALUE

    def unary(self) -> int:
        k = self.k
        t = k[self.p]
        if t in _PREFIX:
            self.p += 1
            self.unary()
            if k[self.p] == "**":
                self.fail()
            return VALUE
        if t == "++" or t == "--":
            self.p += 1
            if self.unary() != TARGET:
                self.fail()
            return VALUE
        if t == "await":
            if not self.asynchronous and not self.ts:
                self.fail()
            self.p += 1
            self.unary()
            return VALUE
        if t == "<" and self.ts:
            self.p += 1
            if not self.has("const"):
                self.type()
            self.take(">")
            self.unary()
            return VALUE
        if t == "#":
            # the test of a private name: #x in object
            self.p += 1
            self.take_in(_WORD)
            if k[self.p] != "in":
                self.fail()
            return VALUE
        kind = self.postfix()
        if (k[self.p] == "++" or k[self.p] == "--") and not self.nl[self.p]:
            if kind != TARGET:
                self.fail()
            self.p += 1
            return VALUE
        return kind

    def postfix(self, no_object: bool = False) -> int:
        k = self.k
        kind = self.new() if k[self.p] == "new" else self.primary()
        optional = False
        ts = self.ts
        while True:
            t = k[self.p]
            if t == ".":
                self.p += 1
                if k[self.p] == "#":
                    self.p += 1
                self.take_in(_WORD)
                kind = VALUE if optional else TARGET
            elif t == "(":
                self.arguments()
                kind = VALUE
            elif t == "[":
                self.index()
                kind = VALUE if optional else TARGET
            elif t == "?.":
                self.p += 1
                optional = True
                kind = VALUE
                if k[self.p] == "(":
                    self.arguments()
                elif k[self.p] == "[":
                    self.index()
                elif ts and k[self.p] == "<":
                    self.type_arguments()
                    self.arguments()
                else:
                    self.has("#")
                    self.take_in(_WORD)
            elif t == "TPL":
                if optional:
                    self.fail()
                self.p += 1
                kind = VALUE
            elif t == "TH":
                if optional:
                    self.fail()
                self.template()
                kind = VALUE
            elif ts and t == "!" and not self.nl[self.p]:
                self.p += 1
            elif ts and t == "<" and not no_object:
                if not self.tries(self.call_types):
                    return kind
                kind = VALUE
            else:
                return kind

    def call_types(self) -> None:
        self.type_arguments()
        t = self.k[self.p]
        if t in ("(", "TPL", "TH"):
            return
        if t in _NO_TYPE_ARGUMENTS and not self.nl[self.p]:
            self.fail()

    def index(self) -> None:
        self.p += 1
        before = self.no_in, self.in_conditional
        self.no_in = self.in_conditional = False
        self.sequence()
        self.no_in, self.in_conditional = before
        self.take("]")

    def template(self) -> None:
        before = self.no_in, self.in_conditional
        self.no_in = self.in_conditional = False
        while True:
            self.p += 1
            self.sequence()
            if self.has("TT"):
                break
            if self.k[self.p] != "TM":
                self.fail()
        self.no_in, self.in_conditional = before

    def new(self) -> int:
        k = self.k
        self.p += 1
        if self.has("."):
            self.take("target")
            return VALUE
        if k[self.p] == "new":
            self.new()
        else:
            if k[self.p] == "import":
                self.fail()
            self.primary()
        while True:
            t = k[self.p]
            if t == ".":
                self.p += 1
                self.has("#")
                self.take_in(_WORD)
            elif t == "[":
                self.index()
            elif t == "TPL":
                self.p += 1
            elif t == "TH":
                self.template()
            elif self.ts and t == "!" and not self.nl[self.p]:
                self.p += 1
            else:
                break
        if self.ts and k[self.p] == "<":
            self.tries(self.type_arguments)
        if k[self.p] == "(":
            self.arguments()
        elif k[self.p] == "?.":
            self.fail()
        return VALUE

    def primary(self) -> int:
        k = self.k
        t = k[self.p]
        if t in _NAMES:
            if t == "async" and k[self.p + 1] == "function" and not self.nl[self.p + 1]:
                self.function_(None)
                return VALUE
            self.p += 1
            return TARGET
        if t in _LITERALS:
            self.p += 1
            return VALUE
        if t == "(":
            return self.parenthesised()
        if t == "[":
            self.p += 1
            close = self.match[self.p - 1]
            before = self.no_in, self.in_conditional
            self.no_in = self.in_conditional = False
            while self.p < close:
                if self.has(","):
                    continue
                self.argument()
                if self.p < close:
                    self.take(",")
            self.no_in, self.in_conditional = before
            self.p += 1
            return VALUE
        if t == "{":
            self.p += 1
            before = self.no_in, self.in_conditional
            self.no_in = self.in_conditional = False
            self.all_in(self.match[self.p - 1], self.property)
            self.no_in, self.in_conditional = before
            return VALUE
        if t == "TH":
            self.template()
            return VALUE
        if t == "function":
            self.function_(None)
            return VALUE
        if t == "class" or t == "@":
            self.decorators()
            self.klass(False)
            return VALUE
        if t == "super":
            self.p += 1
            if k[self.p] not in ("(", ".", "["):
                self.fail()
            return VALUE
        if t == "import":
            self.p += 1
            if k[self.p] == ".":
                self.p += 1
                self.take("meta")
            elif k[self.p] != "(" or self.match[self.p] == self.p + 1:
                self.fail()
            return VALUE
        self.fail()

    def property(self) -> None:
        k, first = self.k, self.p
        t = k[first]
        if t == "...":
            self.p += 1
            self.assign()
            return
        after = k[self.p + 1]
        if t in _NAMES and (after == "," or after == "}"):
            self.p += 1
            return
        if after == ":" and t in _KEYS:
            self.p += 2
            function = t in _WORD and self.function_ahead()
            self.assign()
            if function:
                self.found.append((first, first, self.p))
            return
        asynchronous = generator = False
        if t == "async" and after not in ("(", ":", "<") and not self.nl[self.p + 1]:
            self.p += 1
            asynchronous = True
        if self.has("*"):
            generator = True
        elif t in ("get", "set") and (after in _KEYS or after == "[" or after == "#"):
            self.p += 1
        name = self.p
        self.key(False)
        if k[self.p] == "(" or (self.ts and k[self.p] == "<"):
            named = self.p == name + 1 and k[name] in _WORD
            self.signature_and_body(asynchronous, generator)
            if named:
                self.found.append((name, first, self.p))
        elif asynchronous or generator:
            self.fail()
        else:
            self.take(":")
            self.assign()

    # ---- TypeScript: declarations

    def ts_declaration(self, top: bool) -> bool:
        k = self.k
        t, after = k[self.p], k[self.p + 1]
        if t == "const" and after == "enum":
            self.p += 1
            self.enum()
        elif t == "enum":
            self.enum()
        elif t == "interface" and after in _NAMES:
            self.interface()
        elif t == "type" and after in _NAMES and not self.nl[self.p + 1]:
            self.p += 2
            if k[self.p] == "<":
                self.type_parameters()
            self.take("=")
            self.type()
            self.semi()
        elif t in ("namespace", "module") and (after in _NAMES or after == "STR") and not self.nl[self.p + 1]:
            self.p += 1
            if not self.has("STR"):
                self.name()
                while self.has("."):
                    self.name()
            if k[self.p] == "{":
                self.module_block()
            elif self.ambient or k[self.p - 1] == "STR":
                self.semi()
            else:
                self.fail()
        elif t == "global" and after == "{":
            self.p += 1
            self.module_block()
        elif t == "abstract" and after == "class":
            self.p += 1
            self.klass(True)
        elif t == "declare" and not self.nl[self.p + 1] and (after in _NAMES or after in ("const", "let", "var", "function", "class", "enum", "interface", "import", "async")):
            self.p += 1
            before, self.ambient = self.ambient, True
            if k[self.p] in ("const", "let", "var") and k[self.p + 1] != "enum":
                self._var()
            elif k[self.p] == "function":
                self.function_(self.p - 1)
            elif k[self.p] == "class":
                self.klass(True)
            elif not self.ts_declaration(top):
                self.fail()
            self.ambient = before
        else:
            return False
        return True

    def module_block(self) -> None:
        self.take("{")
        close = self.match[self.p - 1]
        while self.p < close:
            self.item(True)
        self.p += 1

    def enum(self) -> None:
        self.take("enum")
        self.name()
        self.take("{")
        self.all_in(self.match[self.p - 1], self.enum_member)

    def enum_member(self) -> None:
        self.key(False)
        if self.has("="):
            self.assign()

    def interface(self) -> None:
        self.take("interface")
        self.name()
        if self.k[self.p] == "<":
            self.type_parameters()
        if self.has("extends"):
            self.type_list()
        self.object_type()

    def type_list(self) -> None:
        while True:
            self.type_name()
            if not self.has(","):
                return

    # ---- TypeScript: types

    def type_parameters(self) -> None:
        self.take("<")
        while True:
            while self.k[self.p] in ("const", "in", "out") or (self.k[self.p] in _NAMES and self.k[self.p + 1] in _NAMES):
                self.p += 1
            self.name()
            if self.has("extends"):
                self.type()
            if self.has("="):
                self.type()
            if not self.has(","):
                break
            if self.k[self.p] == ">":
                break
        self.take(">")

    def type_arguments(self) -> None:
        self.take("<")
        while True:
            self.type()
            if not self.has(","):
                break
        self.take(">")

    def type_name(self) -> None:
        self.name()
        while self.k[self.p] == "." and self.k[self.p + 1] in _WORD:
            self.p += 2
        if self.k[self.p] == "<" and not self.nl[self.p]:
            self.type_arguments()

    def return_type(self) -> None:
        k = self.k
        if k[self.p] == "asserts" and (k[self.p + 1] in _NAMES or k[self.p + 1] == "this") and k[self.p + 1] != "is" and not self.nl[self.p + 1]:
            self.p += 2
            if self.has("is"):
                self.type()
            return
        if (k[self.p] in _NAMES or k[self.p] == "this") and k[self.p + 1] == "is" and not self.nl[self.p + 1]:
            self.p += 2
        self.type()

    def type(self) -> None:
        k = self.k
        t = k[self.p]
        if t == "<" or t == "new" or (t == "abstract" and k[self.p + 1] == "new") or (t == "(" and k[self.match[self.p] + 1] == "=>"):
            self.has("abstract")
            self.has("new")
            if k[self.p] == "<":
                self.type_parameters()
            before, self.no_conditional = self.no_conditional, False
            self.parameters()
            self.no_conditional = before
            self.take("=>")
            self.return_type()
            return
        self.union()
        if k[self.p] == "extends" and not self.no_conditional:
            self._conditional()

    def _conditional(self) -> None:
        self.p += 1
        self.no_conditional = True
        self.type()
        self.no_conditional = False
        self.take("?")
        self.type()
        self.take(":")
        self.type()

    def union(self) -> None:
        k = self.k
        if k[self.p] in ("|", "&"):
            self.p += 1
        while True:
            self.unary_type()
            if k[self.p] not in ("|", "&"):
                return
            self.p += 1

    def unary_type(self) -> None:
        k = self.k
        t = k[self.p]
        if t in ("keyof", "unique", "readonly") and (k[self.p + 1] in _WORD or k[self.p + 1] in ("(", "[", "{", "STR", "TPL", "TH")):
            self.p += 1
            self.unary_type()
            return
        if t == "infer" and k[self.p + 1] in _NAMES:
            self.p += 2
            if k[self.p] == "extends":
                start = self.p

                def constraint():
                    self.p += 1
                    before, self.no_conditional = self.no_conditional, True
                    try:
                        self.type()
                    finally:
                        self.no_conditional = before
                    if not self.no_conditional and k[self.p] == "?":
                        self.fail()

                if not self.tries(constraint):
                    self.p = start
            return
        self.primary_type()
        while True:
            t = k[self.p]
            if t == "[" and not self.nl[self.p]:
                self.p += 1
                if not self.has("]"):
                    self.inner_type()
                    self.take("]")
            elif t == "!" and not self.nl[self.p]:
                self.p += 1
            else:
                return

    def inner_type(self) -> None:
        before, self.no_conditional = self.no_conditional, False
        self.type()
        self.no_conditional = before

    def primary_type(self) -> None:
        k = self.k
        t = k[self.p]
        if t in _NAMES:
            before, self.no_conditional = self.no_conditional, False
            self.type_name()
            self.no_conditional = before
        elif t in ("STR", "NUM", "LIT", "TPL", "this", "void"):
            self.p += 1
        elif t == "-":
            self.p += 1
            self.take("NUM")
        elif t == "TH":
            while True:
                self.p += 1
                self.inner_type()
                if self.has("TT"):
                    return
                if k[self.p] != "TM":
                    self.fail()
        elif t == "typeof":
            self.p += 1
            if k[self.p] == "import":
                self.import_type()
            else:
                if not self.has("this"):
                    self.name()
                while k[self.p] == "." and (k[self.p + 1] in _WORD or k[self.p + 1] == "#"):
                    self.p += 3 if k[self.p + 1] == "#" else 2
                if k[self.p] == "<" and not self.nl[self.p]:
                    self.type_arguments()
        elif t == "import":
            self.import_type()
        elif t == "{":
            self.object_type()
        elif t == "[":
            self.p += 1
            before, self.no_conditional = self.no_conditional, False
            self.all_in(self.match[self.p - 1], self.tuple_element)
            self.no_conditional = before
        elif t == "(":
            self.p += 1
            self.inner_type()
            self.take(")")
        else:
            self.fail()

    def import_type(self) -> None:
        self.p += 1
        self.take("(")
        self.take("STR")
        self.take(")")
        while self.k[self.p] == "." and self.k[self.p + 1] in _WORD:
            self.p += 2
        if self.k[self.p] == "<":
            self.type_arguments()

    def tuple_element(self) -> None:
        k = self.k
        self.has("...")
        if k[self.p] in _WORD and (k[self.p + 1] == ":" or (k[self.p + 1] == "?" and k[self.p + 2] == ":")):
            self.p += 1
            self.has("?")
            self.p += 1
        self.type()
        self.has("?")

    def object_type(self) -> None:
        self.take("{")
        k, close = self.k, self.match[self.p - 1]
        before, self.no_conditional = self.no_conditional, False
        start = self.p
        if k[self.p] in ("+", "-"):
            self.p += 1
        self.has("readonly") if k[self.p + 1] == "[" or k[self.p - 1] in ("+", "-") else None
        if k[self.p] == "[" and k[self.p + 1] in _NAMES and k[self.p + 2] == "in":
            self.p += 3
            self.type()
            if self.has("as"):
                self.type()
            self.take("]")
            if k[self.p] in ("+", "-"):
                self.p += 1
                self.take("?")
            else:
                self.has("?")
            if self.has(":"):
                self.type()
            if not self.has(";"):
                self.has(",")
        else:
            self.p = start
            while self.p < close:
                self.type_member()
                if self.p < close and not self.has(";") and not self.has(",") and not self.nl[self.p]:
                    self.fail()
        if self.p != close:
            self.fail()
        self.p += 1
        self.no_conditional = before

    def index_signature(self) -> None:
        self.take("[")
        self.name()
        self.take(":")
        self.type()
        self.take("]")
        if self.has(":"):
            self.type()

    def type_member(self) -> None:
        k, first = self.k, self.p
        t = k[first]
        if t == "(" or t == "<":
            self.call_signature()
            return
        if t == "new" and k[self.p + 1] in ("(", "<"):
            self.p += 1
            self.call_signature()
            return
        ends = _MEMBER_END
        while k[self.p] in ("readonly", "static", "public", "private", "protected") and k[self.p + 1] not in ends and not self.nl[self.p + 1]:
            self.p += 1
        if k[self.p] == "[" and k[self.p + 1] in _NAMES and k[self.p + 2] == ":":
            self.index_signature()
            return
        if k[self.p] in ("get", "set") and k[self.p + 1] not in ends and (k[self.p + 1] in _KEYS or k[self.p + 1] == "[") and not self.nl[self.p + 1]:
            self.p += 1
        name = self.p
        self.key(False)
        named = self.p == name + 1 and k[name] in _WORD
        self.has("?")
        if k[self.p] == "(" or k[self.p] == "<":
            self.call_signature()
            if named:
                self.note(name, first)
        elif self.has(":"):
            self.type()

    def call_signature(self) -> None:
        if self.k[self.p] == "<":
            self.type_parameters()
        self.parameters()
        if self.has(":"):
            self.return_type()


_LITERALS = frozenset("NUM STR LIT TPL REGEX this".split())
_STATEMENTS: dict[str, Callable[[_Script], None]] = {
    "{": _Script.block, ";": _Script._empty, "var": _Script._var, "if": _Script._if, "for": _Script._for, "while": _Script._while, "do": _Script._do, "switch": _Script._switch, "try": _Script._try,
    "return": _Script._return, "throw": _Script._throw, "break": _Script._jump, "continue": _Script._jump, "debugger": _Script._debugger,
}


def parses(text: str, typescript: bool = False) -> bool:
    """Whether the text is an ECMAScript module, or a TypeScript file."""
    kinds, lines = lex(text)
    if "?!" in kinds:
        return False
    try:
        _Script(kinds, lines, typescript).program()
        return True
    except (Refused, RecursionError):
        return False


def functions(text: str, typescript: bool = False) -> tuple[list[Function], Source] | None:
    """The named functions of a file and its tokens; None where the text does not parse."""
    tokens = Source([], [], [], [])
    kinds, lines = lex(text, tokens)
    if "?!" in kinds:
        return None
    try:
        parser = _Script(kinds, lines, typescript)
        parser.program()
    except (Refused, RecursionError):
        return None
    return named_functions(text, parser, tokens), tokens
