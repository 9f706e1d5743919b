"""Java."""

from __future__ import annotations

import re

from lodeseam.llm.grammars.base import END, Function, Kinds, Parser, Refused, Source, named_functions, number, source, table

_ESCAPE = r"\\(?:[btnfrs\"'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4})"
_LEX = re.compile(
    rf'//[^\n]*|/\*.*?\*/|"""[^\n"]*\n(?:\\.|[^\\])*?"""|"(?:[^"\\\n]|{_ESCAPE})*"|\'(?:[^\'\\\n]|{_ESCAPE})\''
    r"|(?:0[xX][\w.]*(?:(?<=[pP])[+-]\w*)?|\.?[0-9](?:[\w.]*(?:(?<=[eEpP])[+-]\w+)?))|non-sealed\b|[$\w]+|\.\.\.|->|::|>>>=|<<=|>>=|==|!=|<=|>=|&&|\|\||\+\+|--|<<|[-+*/%&|^]=|\S",
    re.S,
)
_NUMBER = number(
    r"(?:0[xX][0-9a-fA-F](?:[0-9a-fA-F_]*[0-9a-fA-F])?|0[bB][01](?:[01_]*[01])?|[0-9](?:[0-9_]*[0-9])?)[lL]?"
    r"|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?[fFdD]?|0[xX][0-9a-fA-F_]*\.?[0-9a-fA-F_]*[pP][+-]?[0-9]+[fFdD]?"
)
_WORDS = (
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new "
    "package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while _ true false null record sealed permits yield when non-sealed"
)
_MARKS = "( ) [ ] { } ; , . : ? = < > * & | @ -> :: ... + - ! ~ ++ -- += -= *= /= %= &= |= ^= <<= >>= >>>= == != <= >= && || << / % ^"


def _classify(text: str) -> str | None:
    c = text[0]
    if c == "/" and text[:2] in ("//", "/*"):
        return None if text[1] == "/" or (len(text) >= 4 and text.endswith("*/")) else "?!"
    if c in "\"'":
        return "LIT" if len(text) > 1 else "?!"
    if c.isdigit() or (c == "." and len(text) > 1):
        return "LIT" if _NUMBER(text) else "?!"
    return "ID" if c in "_$" or c.isalpha() else "?!"


_KINDS = Kinds(table(_WORDS, _MARKS) | {"true": "LIT", "false": "LIT", "null": "LIT"}, _classify)
_NAMES = frozenset("ID record sealed permits yield when".split())
_PRIMITIVES = frozenset("int long short byte char boolean float double".split())
_MODIFIERS = frozenset("public private protected static final abstract native transient volatile strictfp synchronized default non-sealed".split())
_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>=".split())
_BINARY = frozenset("+ - * / % & | ^ && || == != < <= >= <<".split())
_LITERAL = frozenset(("LIT",))
_CAST_BEFORE = _NAMES | _PRIMITIVES | frozenset("LIT this super new ( ! ~ switch void".split())
_KINDS_OF_TYPE = frozenset("class interface enum".split())
VALUE, VARIABLE, STATEMENT = 0, 1, 2


class _Java(Parser):
    def __init__(self, kinds: list[str], trailing_comma: bool):
        super().__init__(kinds)
        self.trailing_comma = trailing_comma
        self.plain = False  # in a case label, where an arrow ends the expression

    # ---- types: pure look-ahead, -1 where no type stands

    def type_end(self, p: int, dims: bool = True) -> int:
        k = self.k
        while k[p] == "@" and k[p + 1] in _NAMES:
            p = self.annotation_end(p)
        if k[p] in _PRIMITIVES:
            p += 1
        elif k[p] in _NAMES:
            p = self.name_end(p)
            if p < 0:
                return -1
        else:
            return -1
        while dims and (k[p] == "[" or (k[p] == "@" and k[p + 1] in _NAMES)):
            if k[p] == "@":
                q = self.annotation_end(p)
                if k[q] not in ("[", "@"):
                    break
                p = q
                continue
            if k[p + 1] != "]":
                break
            p += 2
        return p

    def annotation_end(self, p: int) -> int:
        k = self.k
        p += 2
        while k[p] == "." and k[p + 1] in _NAMES:
            p += 2
        return self.match[p] + 1 if k[p] == "(" else p

    def name_end(self, p: int, diamond: bool = False) -> int:
        k = self.k
        while True:
            while k[p] == "@" and k[p + 1] in _NAMES:
                p = self.annotation_end(p)
            if k[p] not in _NAMES:
                return -1
            p += 1
            if k[p] == "<":
                if diamond and k[p + 1] == ">":
                    return p + 2
                p = self.arguments_end(p)
                if p < 0:
                    return -1
            if k[p] == "." and (k[p + 1] in _NAMES or k[p + 1] == "@"):
                p += 1
            else:
                return p

    def arguments_end(self, p: int) -> int:
        """Behind the type arguments that open at p."""
        k = self.k
        p += 1
        while True:
            while k[p] == "@" and k[p + 1] in _NAMES:
                p = self.annotation_end(p)
            if k[p] == "?":
                p += 1
                if k[p] in ("extends", "super"):
                    p = self.type_end(p + 1)
            else:
                q = p
                p = self.type_end(p)
                if p > 0 and k[q] in _PRIMITIVES and p == q + 1:
                    return -1
            if p < 0:
                return -1
            if k[p] == ">":
                return p + 1
            if k[p] != ",":
                return -1
            p += 1

    def type(self) -> None:
        end = self.type_end(self.p)
        if end < 0:
            self.fail()
        self.p = end

    def types(self, separator: str = ",") -> None:
        self.type()
        while self.has(separator):
            self.type()

    def dims(self) -> None:
        while self.k[self.p] == "[" and self.k[self.p + 1] == "]":
            self.p += 2

    def name(self) -> None:
        self.take_in(_NAMES)

    def type_parameters(self) -> None:
        self.take("<")
        while True:
            while self.k[self.p] == "@":
                self.annotation()
            self.name()
            if self.has("extends"):
                self.types("&")
            if not self.has(","):
                break
        self.take(">")

    # ---- annotations and modifiers

    def annotation(self) -> None:
        self.take("@")
        self.name()
        while self.k[self.p] == "." and self.k[self.p + 1] in _NAMES:
            self.p += 2
        if self.k[self.p] == "(":
            close = self.match[self.p]
            self.p += 1
            if self.k[self.p] in _NAMES and self.k[self.p + 1] == "=":
                self.all_in(close, self.pair, trailing=False)
            elif self.p < close:
                self.element()
                if self.p != close:
                    self.fail()
                self.p += 1
            else:
                self.p += 1

    def pair(self) -> None:
        self.name()
        self.take("=")
        self.element()

    def element(self) -> None:
        if self.k[self.p] == "@":
            self.annotation()
        elif self.k[self.p] == "{":
            self.p += 1
            self.all_in(self.match[self.p - 1], self.element)
        else:
            self.expr()

    def modifiers(self) -> bool:
        k, start = self.k, self.p
        while True:
            t = k[self.p]
            if t in _MODIFIERS:
                if (t == "default" and k[self.p + 1] in (":", "->")) or (t == "static" and k[self.p + 1] == "{") or (t == "synchronized" and k[self.p + 1] == "("):
                    break
                self.p += 1
            elif t == "@" and k[self.p + 1] != "interface":
                self.annotation()
            elif t == "sealed" and (k[self.p + 1] in _MODIFIERS or k[self.p + 1] in _KINDS_OF_TYPE):
                self.p += 1
            else:
                break
        return self.p > start

    # ---- declarations

    def unit(self) -> None:
        k = self.k
        start = self.p
        while k[self.p] == "@" and k[self.p + 1] != "interface":
            self.annotation()
        if k[self.p] == "package":
            self.p += 1
            self.qualified()
            self.take(";")
        else:
            self.p = start
        while k[self.p] == "import" or k[self.p] == ";":
            if self.has(";"):
                continue
            self.p += 1
            self.has("static")
            self.name()
            while self.has("."):
                if self.has("*"):
                    break
                self.name()
            self.take(";")
        while k[self.p] != END:
            if self.has(";"):
                continue
            self.modifiers()
            if not self.declared_type():
                self.fail()

    def qualified(self) -> None:
        self.name()
        while self.has("."):
            self.name()

    def declared_type(self) -> bool:
        """A class, interface, enum, record or annotation type, if one stands here."""
        k, t = self.k, self.k[self.p]
        if t == "class":
            self.p += 1
            self.name()
            if k[self.p] == "<":
                self.type_parameters()
            if self.has("extends"):
                self.type()
            if self.has("implements"):
                self.types()
            if self.has("permits"):
                self.types()
            self.class_body()
        elif t == "interface":
            self.p += 1
            self.name()
            if k[self.p] == "<":
                self.type_parameters()
            if self.has("extends"):
                self.types()
            if self.has("permits"):
                self.types()
            self.class_body()
        elif t == "enum":
            self.p += 1
            self.name()
            if self.has("implements"):
                self.types()
            self.enum_body()
        elif t == "record" and k[self.p + 1] in _NAMES and k[self.p + 2] in ("(", "<"):
            self.p += 2
            if k[self.p] == "<":
                self.type_parameters()
            self.parameters()
            if self.has("implements"):
                self.types()
            self.class_body(record=True)
        elif t == "@" and k[self.p + 1] == "interface":
            self.p += 2
            self.name()
            self.class_body()
        else:
            return False
        return True

    def class_body(self, record: bool = False) -> None:
        self.take("{")
        close = self.match[self.p - 1]
        while self.p < close:
            self.member(record)
        self.p += 1

    def enum_body(self) -> None:
        self.take("{")
        k, close = self.k, self.match[self.p - 1]
        while k[self.p] in _NAMES or k[self.p] == "@":
            while k[self.p] == "@":
                self.annotation()
            self.name()
            if k[self.p] == "(":
                self.arguments()
            if k[self.p] == "{":
                self.class_body()
            if not self.has(","):
                break
        else:
            self.has(",")
        if self.p < close:
            self.take(";")
            while self.p < close:
                self.member(False)
        self.p += 1

    def member(self, record: bool) -> None:
        k = self.k
        t = k[self.p]
        if t == ";":
            self.p += 1
            return
        if t == "{":
            self.block()
            return
        if t == "static" and k[self.p + 1] == "{":
            self.p += 1
            self.block()
            return
        first = self.p
        self.modifiers()
        if self.declared_type():
            return
        if k[self.p] == "<":
            self.type_parameters()
            while k[self.p] == "@":
                self.annotation()
        if k[self.p] in _NAMES and (k[self.p + 1] == "(" or (record and k[self.p + 1] == "{")):
            name = self.p
            self.p += 1
            if k[self.p] == "(":
                self.parameters()
                self.throws()
            self.block()
            self.found.append((name, first, self.p))
            return
        if not self.has("void"):
            self.type()
        elif k[self.p + 1] != "(":
            self.fail()
        name = self.p
        self.name()
        if k[self.p] == "(":
            self.parameters()
            self.dims()
            self.throws()
            if k[self.p] == "{":
                self.block()
            else:
                if self.has("default"):
                    self.element()
                self.take(";")
            self.found.append((name, first, self.p))
        else:
            self.declarators(first)
            self.take(";")

    def throws(self) -> None:
        if self.has("throws"):
            self.types()

    def parameters(self) -> None:
        self.take("(")
        self.all_in(self.match[self.p - 1], self.parameter, trailing=self.trailing_comma)

    def parameter(self) -> None:
        while self.k[self.p] == "final" or self.k[self.p] == "@":
            if not self.has("final"):
                self.annotation()
        self.type()
        while self.k[self.p] == "@":
            self.annotation()
        self.has("...")
        if self.has("this"):
            return
        self.name()
        if self.k[self.p] == "." and self.k[self.p + 1] == "this":
            self.p += 2
            return
        self.dims()

    def declarators(self, first: int) -> None:
        """What follows the first name of a declaration of variables that begins with the given token."""
        k = self.k
        while True:
            name = self.p - 1
            self.dims()
            if self.has("="):
                function = (k[self.p] in _NAMES and k[self.p + 1] == "->") or (k[self.p] == "(" and k[self.match[self.p] + 1] == "->")
                self.initial()
                if function:
                    self.note(name, first)
            if not self.has(","):
                return
            first = self.p
            self.name()

    def initial(self) -> None:
        if self.k[self.p] == "{":
            self.p += 1
            self.all_in(self.match[self.p - 1], self.initial)
        else:
            self.expr()

    # ---- statements

    def block(self) -> None:
        self.take("{")
        close = self.match[self.p - 1]
        while self.p < close:
            self.statement(True)
        self.p += 1

    def declares(self) -> bool:
        """Whether a declaration of local variables stands here."""
        k, p = self.k, self.p
        if k[p] not in _PRIMITIVES and k[p] not in _NAMES:
            return False
        if k[p] in _NAMES and k[p + 1] not in _NAMES and k[p + 1] not in (".", "<", "[", "@"):
            return False
        end = self.type_end(p)
        return end > 0 and k[end] in _NAMES and k[end + 1] in ("=", ";", ",", ":", "[") and not (k[p] == "yield" and end == p + 1)

    def local(self, first: int) -> None:
        self.type()
        self.name()
        self.declarators(first)

    def condition(self) -> None:
        self.take("(")
        self.expr()
        self.take(")")

    def statement(self, declarations: bool = False) -> None:
        k = self.k
        t = k[self.p]
        rule = _STATEMENTS.get(t)
        if rule is not None:
            rule(self)
            return
        if t in _NAMES and k[self.p + 1] == ":":
            self.p += 2
            self.statement()
            return
        if declarations:
            start = self.p
            if t in _MODIFIERS or t == "@" or t in _KINDS_OF_TYPE or t == "record" or t == "sealed":
                if self.modifiers() or t in _KINDS_OF_TYPE or t == "record":
                    if self.declared_type():
                        return
                    if self.p > start:
                        self.local(start)
                        self.take(";")
                        return
            if self.declares():
                self.local(start)
                self.take(";")
                return
        if t == "yield" and k[self.p + 1] not in _ASSIGN and k[self.p + 1] not in (".", "[", "(") or t == "yield" and k[self.p + 1] == "(":
            self.p += 1
            self.expr()
            self.take(";")
            return
        if t == "synchronized":
            self.p += 1
            self.condition()
            self.block()
            return
        if self.expr() != STATEMENT:
            self.fail()
        self.take(";")

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

    def _for(self) -> None:
        self.p += 1
        self.take("(")
        k, close = self.k, self.match[self.p - 1]
        start = self.p
        while k[self.p] == "final" or k[self.p] == "@":
            if not self.has("final"):
                self.annotation()
        if self.p > start or self.declares():
            self.type()
            self.name()
            if self.has(":"):
                self.expr()
                self.p_at(close)
                self.statement()
                return
            self.declarators(start)
        elif k[self.p] != ";":
            self.expressions()
        self.take(";")
        if k[self.p] != ";":
            self.expr()
        self.take(";")
        if self.p < close:
            self.expressions()
        self.p_at(close)
        self.statement()

    def p_at(self, close: int) -> None:
        if self.p != close:
            self.fail()
        self.p += 1

    def expressions(self) -> None:
        while True:
            if self.expr() != STATEMENT:
                self.fail()
            if not self.has(","):
                return

    def _while(self) -> None:
        self.p += 1
        self.condition()
        self.statement()

    def _do(self) -> None:
        self.p += 1
        self.statement()
        self.take("while")
        self.condition()
        self.take(";")

    def _return(self) -> None:
        self.p += 1
        if self.k[self.p] != ";":
            self.expr()
        self.take(";")

    def _throw(self) -> None:
        self.p += 1
        self.expr()
        self.take(";")

    def _jump(self) -> None:
        self.p += 1
        if self.k[self.p] in _NAMES:
            self.p += 1
        self.take(";")

    def _assert(self) -> None:
        self.p += 1
        self.expr()
        if self.has(":"):
            self.expr()
        self.take(";")

    def _try(self) -> None:
        self.p += 1
        k = self.k
        needed = True
        if k[self.p] == "(":
            needed = False
            close = self.match[self.p]
            self.p += 1
            if self.p == close:
                self.fail()
            self.all_in(close, self.resource, ";")
        self.block()
        while k[self.p] == "catch":
            self.p += 1
            self.take("(")
            while k[self.p] == "final" or k[self.p] == "@":
                if not self.has("final"):
                    self.annotation()
            self.types("|")
            self.name()
            self.take(")")
            self.block()
            needed = False
        if self.has("finally"):
            self.block()
            needed = False
        if needed:
            self.fail()

    def resource(self) -> None:
        start = self.p
        while self.k[self.p] == "final" or self.k[self.p] == "@":
            if not self.has("final"):
                self.annotation()
        if self.p > start or self.declares():
            self.type()
            self.name()
            self.take("=")
        self.expr()

    def _switch(self) -> None:
        """The statement; with a mark or an operator behind it, it would be an expression that does nothing."""
        self.switch()

    def switch(self) -> None:
        self.p += 1
        self.condition()
        self.take("{")
        k, close = self.k, self.match[self.p - 1]
        while self.p < close:
            if self.has("default"):
                pass
            else:
                self.take("case")
                while True:
                    self.label()
                    if not self.has(","):
                        break
            if self.has("->"):
                if k[self.p] == "{":
                    self.block()
                elif k[self.p] == "throw":
                    self._throw()
                else:
                    self.expr()
                    self.take(";")
            else:
                self.take(":")
                while self.p < close and k[self.p] != "case" and not (k[self.p] == "default" and k[self.p + 1] in (":", "->")):
                    self.statement(True)
        self.p += 1

    def label(self) -> None:
        if self.has("default"):
            return
        if not self.tries(self.pattern):
            before, self.plain = self.plain, True
            self.expr()
            self.plain = before
        if self.k[self.p] == "when":
            self.p += 1
            before, self.plain = self.plain, True
            self.expr()
            self.plain = before

    def pattern(self) -> None:
        self.has("final")
        self.type()
        if self.k[self.p] == "(":
            self.p += 1
            self.all_in(self.match[self.p - 1], self.pattern, trailing=False)
            if self.k[self.p] in _NAMES and self.k[self.p] != "when":
                self.p += 1
        else:
            self.name()
            if self.k[self.p - 1] == "when" and self.k[self.p] not in ("->", ":", ")", ",", "when"):
                self.fail()

    # ---- expressions

    def expr(self) -> int:
        k = self.k
        t = k[self.p]
        if t in _NAMES and k[self.p + 1] == "->" and not self.plain:
            self.p += 2
            self.lambda_body()
            return VALUE
        kind = self.unary()
        while True:
            t = k[self.p]
            if t in _BINARY:
                self.p += 1
            elif t == ">":
                self.p += 1
                if k[self.p] == ">":
                    self.p += 1
                    if k[self.p] == ">":
                        self.p += 1
            elif t == "instanceof":
                self.p += 1
                self.has("final")
                while k[self.p] == "@":
                    self.annotation()
                self.type()
                if k[self.p] == "(":
                    self.p += 1
                    self.all_in(self.match[self.p - 1], self.pattern, trailing=False)
                if k[self.p] in _NAMES and k[self.p] != "when":
                    self.p += 1
                kind = VALUE
                continue
            elif t == "?":
                self.p += 1
                before, self.plain = self.plain, False
                self.expr()
                self.plain = before
                self.take(":")
                self.expr()
                return VALUE
            elif t in _ASSIGN:
                if kind != VARIABLE:
                    self.fail()
                self.p += 1
                self.expr()
                return STATEMENT
            else:
                return kind
            if k[self.p] in _NAMES and k[self.p + 1] == "->" and not self.plain:
                self.fail()
            self.unary()
            kind = VALUE

    def lambda_body(self) -> None:
        before, self.plain = self.plain, False
        if self.k[self.p] == "{":
            self.block()
        else:
            self.expr()
        self.plain = before

    def arguments(self) -> None:
        self.p += 1
        before, self.plain = self.plain, False
        self.all_in(self.match[self.p - 1], self.expr, trailing=False)
        self.plain = before

    def unary(self) -> int:
        k = self.k
        t = k[self.p]
        if t == "++" or t == "--":
            self.p += 1
            if self.unary() != VARIABLE:
                self.fail()
            return STATEMENT
        if t in ("+", "-", "!", "~"):
            self.p += 1
            self.unary()
            return VALUE
        if t == "(":
            close = self.match[self.p]
            after = k[close + 1]
            if after == "->" and not self.plain:
                self.lambda_parameters(close)
                self.lambda_body()
                return VALUE
            end = self.type_end(self.p + 1)
            while end > 0 and k[end] == "&":
                end = self.type_end(end + 1)
            if end == close:
                primitive = k[self.p + 1] in _PRIMITIVES
                if (primitive and (end == self.p + 2 or after in _CAST_BEFORE)) or (not primitive and after in _CAST_BEFORE) or (primitive and after in ("+", "-", "++", "--")):
                    self.p = close + 1
                    if k[self.p] in _NAMES and k[self.p + 1] == "->" and not self.plain:
                        self.p += 2
                        self.lambda_body()
                    else:
                        self.unary()
                    return VALUE
        return self.primary()

    def lambda_parameters(self, close: int) -> None:
        self.p += 1
        k = self.k
        if k[self.p] in _NAMES and k[self.p + 1] in (",", ")"):
            self.all_in(close, self.name, trailing=False)
        else:
            self.all_in(close, self.parameter, trailing=False)
        self.take("->")

    def primary(self) -> int:
        k = self.k
        t = k[self.p]
        kind = VALUE
        called = False  # whether a name stands before the next bracket
        if t in _NAMES:
            after = k[self.p + 1]
            if after == "." or after == "<" or after == "[":
                q = self.p + 1
                while k[q] == "." and k[q + 1] in _NAMES:
                    q += 2
                if k[q] == "<" or (k[q] == "[" and k[q + 1] == "]"):
                    end = self.type_end(self.p)
                    if end > 0 and (k[end] == "::" or (k[end] == "." and k[end + 1] == "class")):
                        self.p = end
                        return self.suffixes(VALUE, False)
            self.p += 1
            kind, called = VARIABLE, True
        elif t == "LIT":
            self.p += 1
        elif t == "this":
            self.p += 1
            called = True
        elif t == "super":
            self.p += 1
            if k[self.p] not in (".", "::", "("):
                self.fail()
            called = True
        elif t == "(":
            self.p += 1
            before, self.plain = self.plain, False
            inner = self.expr()
            self.plain = before
            self.take(")")
            kind = VARIABLE if inner == VARIABLE else VALUE
        elif t == "new":
            kind = self.creation()
        elif t == "switch":
            self.switch()
        elif t in _PRIMITIVES or t == "void":
            self.p += 1
            self.dims()
            if k[self.p] == "::" and t != "void" and k[self.p - 1] == "]":
                pass
            elif not (k[self.p] == "." and k[self.p + 1] == "class"):
                self.fail()
        else:
            self.fail()
        return self.suffixes(kind, called)

    def creation(self) -> int:
        k = self.k
        self.p += 1
        if k[self.p] == "<":
            self.p = self.arguments_end(self.p)
            if self.p < 0:
                raise Refused
        while k[self.p] == "@":
            self.annotation()
        if k[self.p] in _PRIMITIVES:
            self.p += 1
        else:
            end = self.name_end(self.p, True)
            if end < 0:
                self.fail()
            self.p = end
        if k[self.p] == "(":
            self.arguments()
            if k[self.p] == "{":
                self.class_body()
            return STATEMENT
        while k[self.p] == "@":
            self.annotation()
        if k[self.p] != "[":
            self.fail()
        if k[self.p + 1] == "]":
            self.dims()
            if k[self.p] != "{":
                self.fail()
            self.initial()
            return VALUE
        while k[self.p] == "[" and k[self.p + 1] != "]":
            self.p += 1
            self.expr()
            self.take("]")
        self.dims()
        return VALUE

    def suffixes(self, kind: int, called: bool) -> int:
        k = self.k
        while True:
            t = k[self.p]
            if t == ".":
                self.p += 1
                t = k[self.p]
                if t in _NAMES:
                    self.p += 1
                    kind, called = VARIABLE, True
                elif t == "<":
                    self.p = self.arguments_end(self.p)
                    if self.p < 0:
                        raise Refused
                    if not self.has("super"):
                        self.name()
                    if k[self.p] != "(":
                        self.fail()
                    called = True
                elif t == "new":
                    kind, called = self.creation(), False
                elif t == "class":
                    self.p += 1
                    kind, called = VALUE, False
                elif t == "this" or t == "super":
                    self.p += 1
                    kind, called = VALUE, t == "super"
                else:
                    self.fail()
            elif t == "(":
                if not called:
                    self.fail()
                self.arguments()
                kind, called = STATEMENT, False
            elif t == "[":
                self.p += 1
                before, self.plain = self.plain, False
                self.expr()
                self.plain = before
                self.take("]")
                kind, called = VARIABLE, False
            elif t == "++" or t == "--":
                if kind != VARIABLE:
                    self.fail()
                self.p += 1
                kind, called = STATEMENT, False
            elif t == "::":
                self.p += 1
                if k[self.p] == "<":
                    self.p = self.arguments_end(self.p)
                    if self.p < 0:
                        raise Refused
                if not self.has("new"):
                    self.name()
                return VALUE
            else:
                return kind


def _empty(parser: _Java) -> None:
    parser.p += 1


_STATEMENTS = {
    "{": _Java.block, ";": _empty, "if": _Java._if, "for": _Java._for, "while": _Java._while, "do": _Java._do, "return": _Java._return, "throw": _Java._throw, "break": _Java._jump, "continue": _Java._jump,
    "assert": _Java._assert, "try": _Java._try, "switch": _Java._switch,
}


def parses(text: str, trailing_comma: bool = False) -> bool:
    """Whether the text is a compilation unit; trailing_comma accepts a comma behind the last parameter of a method."""
    kinds = [kind for kind in map(_KINDS.__getitem__, _LEX.findall(text)) if kind is not None]
    if "?!" in kinds:
        return False
    try:
        _Java(kinds, trailing_comma).unit()
        return True
    except (Refused, RecursionError):
        return False


def functions(text: str, trailing_comma: bool = False) -> tuple[list[Function], Source] | None:
    """The named functions of a compilation unit and its tokens; None where the text is none."""
    tokens = source(text, _LEX, _KINDS)
    if "?!" in tokens.kinds:
        return None
    try:
        parser = _Java(tokens.kinds, trailing_comma)
        parser.unit()
    except (Refused, RecursionError):
        return None
    return named_functions(text, parser, tokens), tokens
