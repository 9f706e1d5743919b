"""Go."""

from __future__ import annotations

import re

from lodeseam.llm.grammars.base import END, Function, Kinds, Parser, Refused, Source, named_functions, number, source, table

_ESCAPE = r"\\(?:[abfnrtv\\'\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})"
_LEX = re.compile(
    rf'//[^\n]*|/\*.*?\*/|\n\s*|"(?:[^"\\\n]|{_ESCAPE})*"|\'(?:[^\'\\\n]|{_ESCAPE})\'|`[^`]*`'
    r"|0[xX][\w.]*(?:(?<=[pP])[+-]\w*)?|\.?[0-9][\w.]*(?:(?<=[eE])[+-]\w+)?|\w+|\.\.\.|:=|<-|&\^=|&\^|<<=|>>=|==|!=|<=|>=|&&|\|\||\+\+|--|<<|>>|[-+*/%&|^]=|\S",
    re.S,
)
_NUMBER = number(
    r"(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO]?(?:_?[0-7])*|[1-9](?:_?[0-9])*|0[0-9_]*(?=i))i?"
    r"|(?:[0-9](?:_?[0-9])*\.?(?:[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?i?"
    r"|0[xX](?:_?[0-9a-fA-F])*\.?(?:[0-9a-fA-F](?:_?[0-9a-fA-F])*)?[pP][+-]?[0-9]+i?"
)
_OLD_OCTAL = re.compile(r"0[0-9_]*[89][0-9_]*\Z").match
_WORDS = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"
_MARKS = "( ) [ ] { } ; , . : = * & ~ | := <- ... + - ! ^ ++ -- += -= *= /= %= &= |= ^= <<= >>= &^= == != <= >= && || << >> / % &^ < >"


def _classify(text: str) -> str | None:
    c = text[0]
    if c == "/" and text[:2] in ("//", "/*"):
        if text[1] == "*" and not (len(text) >= 4 and text.endswith("*/")):
            return "?!"
        return "\n" if "\n" in text else None
    if c == "\n":
        return "\n"
    if c in "\"`":
        return "STR" if len(text) > 1 else "?!"
    if c == "'":
        return "LIT" if len(text) > 1 else "?!"
    if c.isdigit() or (c == "." and len(text) > 1):
        return "LIT" if _NUMBER(text) and not _OLD_OCTAL(text) else "?!"
    return "ID" if c == "_" or c.isalpha() else "?!"


_KINDS = Kinds(table(_WORDS, _MARKS), _classify)
#: A line that ends in one of these ends a statement.
_ENDS = frozenset("ID LIT STR break continue fallthrough return ++ -- ) ] }".split())
_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= &^=".split())
_BINARY = frozenset("+ - * / % & | ^ && || == != < <= > >= << >> &^".split())
_UNARY = frozenset("+ - ! ^ * & <- ~".split())
_TYPES = frozenset("ID * [ map chan <- func struct interface (".split())
VALUE, NAME, CALL = 0, 1, 2


class _Go(Parser):
    def __init__(self, kinds: list[str]):
        super().__init__(kinds)
        self.header = False  # between a keyword and its block, where a brace opens the block

    def semi(self) -> None:
        """The end of a statement; a closing bracket may stand for it."""
        t = self.k[self.p]
        if t == ";":
            self.p += 1
        elif t != ")" and t != "}":
            self.fail()

    # ---- declarations

    def file(self) -> None:
        k = self.k
        while self.has(";"):
            pass
        self.take("package")
        self.take("ID")
        self.end()
        while k[self.p] == "import":
            self.p += 1
            self.group(self.import_spec)
            self.end()
        while k[self.p] != END:
            if k[self.p] == "func":
                self.function()
            elif k[self.p] in _DECLARATIONS:
                self.declaration()
            else:
                self.fail()
            self.end()

    def end(self) -> None:
        if self.k[self.p] == END:
            return
        self.take(";")

    def group(self, spec) -> None:
        if self.k[self.p] != "(":
            spec()
            return
        self.p += 1
        close = self.match[self.p - 1]
        while self.p < close:
            spec()
            self.semi()
        self.p += 1

    def import_spec(self) -> None:
        if self.k[self.p] in ("ID", "."):
            self.p += 1
        self.take("STR")

    def declaration(self) -> None:
        kind = self.k[self.p]
        self.p += 1
        self.group(_SPECS[kind].__get__(self))

    def names(self) -> None:
        self.take("ID")
        while self.has(","):
            self.take("ID")

    def const_spec(self) -> None:
        self.names()
        if self.k[self.p] in _TYPES:
            self.type()
            self.take("=")
            self.expressions()
        elif self.has("="):
            self.expressions()

    def var_spec(self) -> None:
        start = self.p
        self.names()
        if self.has("="):
            function = self.p == start + 2 and self.k[self.p] == "func"
            self.expressions()
            if function:
                self.found.append((start, start - 1 if self.k[start - 1] == "var" else start, self.p))
            return
        self.type()
        if self.has("="):
            self.expressions()

    def type_spec(self) -> None:
        k = self.k
        self.take("ID")
        if k[self.p] == "[" and k[self.p + 1] == "ID" and k[self.p + 2] != "]":
            start = self.p

            def generic():
                self.type_parameters()
                self.has("=")
                self.type()

            if self.tries(generic):
                return
            self.p = start
        self.has("=")
        self.type()

    def type_parameters(self) -> None:
        self.take("[")
        self.all_in(self.match[self.p - 1], self.type_parameter)

    def type_parameter(self) -> None:
        self.take("ID")
        if self.k[self.p] != ",":
            self.constraint()

    def constraint(self) -> None:
        while True:
            self.has("~")
            self.type()
            if not self.has("|"):
                return

    def function(self) -> None:
        k, first = self.k, self.p
        self.p += 1
        if k[self.p] == "(":
            self.parameters()
        name = self.p
        self.take("ID")
        if k[self.p] == "[":
            self.type_parameters()
        self.signature()
        if k[self.p] == "{":
            self.body()
        self.found.append((name, first, self.p))

    def signature(self) -> None:
        k = self.k
        self.parameters()
        if k[self.p] == "(":
            self.parameters()
        elif k[self.p] in _TYPES:
            self.type()

    def parameters(self) -> None:
        self.take("(")
        close = self.match[self.p - 1]
        named = plain = bare = 0
        k = self.k
        while self.p < close:
            kind = self.parameter(close)
            if kind == "named":
                named += 1
                bare = 0
            elif kind == "name":
                bare += 1
            else:
                plain += 1
            if self.p < close:
                self.take(",")
                if k[self.p] == ";":
                    self.fail()
        if named and (plain or bare):
            self.fail()
        self.p += 1

    def parameter(self, close: int) -> str:
        k = self.k
        if k[self.p] == "ID":
            after = k[self.p + 1]
            if after == "," or self.p + 1 == close:
                self.p += 1
                return "name"
            if after == "[":
                def with_name():
                    self.p += 1
                    self.has("...")
                    self.type()
                    if self.p != close and k[self.p] != ",":
                        self.fail()

                if self.tries(with_name):
                    return "named"
            elif after != ".":
                self.p += 1
                self.has("...")
                self.type()
                return "named"
        self.has("...")
        self.type()
        return "plain"

    # ---- types

    def type(self) -> None:
        k = self.k
        t = k[self.p]
        if t == "ID":
            self.p += 1
            if k[self.p] == "." and k[self.p + 1] == "ID":
                self.p += 2
            if k[self.p] == "[" and k[self.p + 1] != "]":
                self.p += 1
                before, self.header = self.header, False
                self.all_in(self.match[self.p - 1], self.type)
                self.header = before
        elif t == "*":
            self.p += 1
            self.type()
        elif t == "[":
            self.p += 1
            if self.has("..."):
                pass
            elif k[self.p] != "]":
                before, self.header = self.header, False
                self.expr()
                self.header = before
            self.take("]")
            self.type()
        elif t == "map":
            self.p += 1
            self.take("[")
            self.type()
            self.take("]")
            self.type()
        elif t == "chan":
            self.p += 1
            self.has("<-")
            self.type()
        elif t == "<-":
            self.p += 1
            self.take("chan")
            self.type()
        elif t == "func":
            self.p += 1
            self.signature()
        elif t == "struct":
            self.p += 1
            self.take("{")
            close = self.match[self.p - 1]
            while self.p < close:
                self.field()
                self.semi()
            self.p += 1
        elif t == "interface":
            self.p += 1
            self.take("{")
            close = self.match[self.p - 1]
            while self.p < close:
                if k[self.p] == "ID" and k[self.p + 1] == "(":
                    self.p += 1
                    self.signature()
                else:
                    self.constraint()
                self.semi()
            self.p += 1
        elif t == "(":
            self.p += 1
            self.type()
            self.take(")")
        else:
            self.fail()

    def field(self) -> None:
        k = self.k
        if k[self.p] == "*":
            self.type()
        elif k[self.p] == "ID" and k[self.p + 1] in (";", "}", ".", "STR"):
            self.type()
        elif k[self.p] == "ID" and k[self.p + 1] == "[":
            start = self.p

            def named():
                self.p += 1
                self.type()
                if k[self.p] not in (";", "}", "STR"):
                    self.fail()

            if not self.tries(named):
                self.p = start
                self.type()
        else:
            self.names()
            self.type()
        self.has("STR")

    # ---- statements

    def body(self) -> None:
        before, self.header = self.header, False
        self.block()
        self.header = before

    def block(self) -> None:
        self.take("{")
        self.statements(self.match[self.p - 1])
        self.p += 1

    def statements(self, close: int) -> None:
        k = self.k
        while self.p < close:
            t = k[self.p]
            if t == "case" or t == "default":
                return
            if t != ";":
                self.statement()
            if self.p < close:
                self.take(";")

    def statement(self) -> None:
        k = self.k
        t = k[self.p]
        if t == "ID" and k[self.p + 1] == ":":
            self.p += 2
            if k[self.p] not in (";", "}"):
                self.statement()
            return
        rule = _STATEMENTS.get(t)
        if rule is not None:
            rule(self)
        else:
            self.simple()

    def simple(self, ranges: bool = False) -> bool:
        """A simple statement; whether it is the head of a loop over a range."""
        k = self.k
        start = self.p
        kind = self.expr()
        count, names = 1, kind == NAME
        while self.has(","):
            names &= self.expr() == NAME
            count += 1
        t = k[self.p]
        if t == ":=" or t == "=":
            if t == ":=" and not names:
                self.fail()
            self.p += 1
            if ranges and self.has("range"):
                self.expr()
                return True
            function = self.p == start + 2 and k[self.p] == "func"
            self.expressions()
            if function:
                self.found.append((start, start, self.p))
        elif count > 1:
            self.fail()
        elif t in _ASSIGN:
            self.p += 1
            self.expr()
        elif t == "++" or t == "--":
            self.p += 1
        elif t == "<-":
            self.p += 1
            self.expr()
        elif self.p == start:
            self.fail()
        return False

    def expressions(self) -> None:
        self.expr()
        while self.has(","):
            self.expr()

    def _if(self) -> None:
        while True:
            self.p += 1
            before, self.header = self.header, True
            if self.k[self.p] != ";":
                self.simple()
            if self.has(";"):
                self.simple()
            self.header = before
            self.block()
            if not self.has("else"):
                return
            if self.k[self.p] != "if":
                self.block()
                return

    def _for(self) -> None:
        k = self.k
        self.p += 1
        before, self.header = self.header, True
        if k[self.p] == "range":
            self.p += 1
            self.expr()
        elif k[self.p] != "{":
            looped = False
            if k[self.p] != ";":
                looped = self.simple(True)
            if not looped and k[self.p] == ";":
                self.p += 1
                if k[self.p] != ";":
                    self.simple()
                self.take(";")
                if k[self.p] != "{":
                    self.simple()
        self.header = before
        self.block()

    def _switch(self) -> None:
        k = self.k
        self.p += 1
        before, self.header = self.header, True
        if k[self.p] != "{":
            if k[self.p] != ";":
                self.simple()
            if self.has(";") and k[self.p] != "{":
                self.simple()
        self.header = before
        self.cases(self.expressions)

    def _select(self) -> None:
        self.p += 1
        self.cases(self.simple)

    def cases(self, label) -> None:
        self.take("{")
        close = self.match[self.p - 1]
        while self.p < close:
            if not self.has("default"):
                self.take("case")
                label()
            self.take(":")
            self.statements(close)
        self.p += 1

    def _return(self) -> None:
        self.p += 1
        if self.k[self.p] not in (";", "}"):
            self.expressions()

    def _jump(self) -> None:
        kind = self.k[self.p]
        self.p += 1
        if kind == "goto":
            self.take("ID")
        elif kind != "fallthrough":
            self.has("ID")

    def _call(self) -> None:
        self.p += 1
        if self.expr() != CALL:
            self.fail()

    # ---- expressions; types may stand for operands

    def expr(self) -> int:
        k = self.k
        kind = self.unary()
        while k[self.p] in _BINARY:
            self.p += 1
            self.unary()
            kind = VALUE
        return kind

    def unary(self) -> int:
        k = self.k
        if k[self.p] in _UNARY:
            while k[self.p] in _UNARY:
                if k[self.p] == "<-" and k[self.p + 1] == "chan":
                    break
                self.p += 1
            self.operand()
            return VALUE
        return self.operand()

    def operand(self) -> int:
        k = self.k
        t = k[self.p]
        kind = VALUE
        literal = False  # whether a brace could open a composite literal of what stands before it
        if t == "ID":
            self.p += 1
            kind, literal = NAME, not self.header
        elif t == "LIT" or t == "STR":
            self.p += 1
        elif t == "(":
            self.p += 1
            before, self.header = self.header, False
            kind = CALL if self.expr() == CALL else VALUE
            self.header = before
            self.take(")")
        elif t == "func":
            self.p += 1
            self.signature()
            if k[self.p] == "{":
                self.body()
        elif t in ("[", "map", "struct"):
            self.type()
            literal = True
        elif t in ("chan", "interface", "<-"):
            self.type()
        else:
            self.fail()
        while True:
            t = k[self.p]
            if t == ".":
                self.p += 1
                if k[self.p] == "(":
                    self.p += 1
                    if not self.has("type"):
                        self.type()
                    self.take(")")
                    literal = False
                    kind = VALUE
                else:
                    self.take("ID")
                    if kind != NAME:
                        literal = False
                    kind = VALUE
            elif t == "(":
                self.p += 1
                before, self.header = self.header, False
                self.all_in(self.match[self.p - 1], self.argument)
                self.header = before
                kind, literal = CALL, False
            elif t == "[":
                self.index()
                kind = VALUE
            elif t == "{" and literal:
                self.literal()
                kind, literal = VALUE, False
            else:
                return kind

    def argument(self) -> None:
        self.expr()
        self.has("...")

    def index(self) -> None:
        k = self.k
        self.p += 1
        close = self.match[self.p - 1]
        before, self.header = self.header, False
        colons = 0
        if self.p == close:
            self.fail()
        while self.p < close:
            if self.has(":"):
                colons += 1
                continue
            self.expr()
            if k[self.p] == "," and not colons:
                self.p += 1
            elif self.p < close and k[self.p] != ":":
                self.fail()
        if colons > 2:
            self.fail()
        self.header = before
        self.p += 1

    def literal(self) -> None:
        self.p += 1
        before, self.header = self.header, False
        self.all_in(self.match[self.p - 1], self.element)
        self.header = before

    def element(self) -> None:
        self.value()
        if self.has(":"):
            self.value()

    def value(self) -> None:
        if self.k[self.p] == "{":
            self.literal()
        else:
            self.expr()


_DECLARATIONS = frozenset(("const", "var", "type"))
_SPECS = {"const": _Go.const_spec, "var": _Go.var_spec, "type": _Go.type_spec}
_STATEMENTS = {
    "{": _Go.block, "if": _Go._if, "for": _Go._for, "switch": _Go._switch, "select": _Go._select, "return": _Go._return, "break": _Go._jump, "continue": _Go._jump, "goto": _Go._jump, "fallthrough": _Go._jump,
    "go": _Go._call, "defer": _Go._call, "const": _Go.declaration, "var": _Go.declaration, "type": _Go.declaration,
}


def _statements(kinds: list[str | None]) -> tuple[list[str], list[int]]:
    """The kinds with line ends turned into semicolons or left out, and the numbers of the tokens that stay."""
    out: list[str] = []
    kept: list[int] = []
    last = ""
    for at, kind in enumerate(kinds):
        if kind is None:
            continue
        if kind == "\n":
            if last not in _ENDS:
                continue
            kind = ";"
        out.append(kind)
        kept.append(at)
        last = kind
    if last in _ENDS:
        out.append(";")
        kept.append(len(kinds) - 1)
    return out, kept


def parses(text: str) -> bool:
    """Whether the text is a source file."""
    kinds, _ = _statements([_KINDS[t] for t in _LEX.findall(text)])
    if "?!" in kinds:
        return False
    try:
        _Go(kinds).file()
        return True
    except (Refused, RecursionError):
        return False


def functions(text: str) -> tuple[list[Function], Source] | None:
    """The named functions of a source file and its tokens; None where the text is none."""
    tokens = source(text, _LEX, _KINDS)
    kinds, kept = _statements(tokens.kinds)
    if "?!" in kinds:
        return None
    try:
        parser = _Go(kinds)
        parser.file()
    except (Refused, RecursionError):
        return None
    tokens = Source(kinds, [tokens.starts[t] for t in kept], [tokens.ends[t] for t in kept], tokens.comments)
    return named_functions(text, parser, tokens), tokens
