"""Rust. The contents of macro calls are token trees: only their brackets have to match."""

from __future__ import annotations

import re

from lodeseam.llm.grammars.base import END, Function, Kinds, Parser, Refused, Source, named_functions, number, source, table

#: Raw strings with up to twelve hashes.
_RAW = "|".join(rf'[bc]?r{"#" * n}".*?"{"#" * n}' for n in range(1, 13))
_NESTED = r"/\*(?:[^*/]|\*(?!/)|/(?!\*))*\*/"
_NESTED = rf"/\*(?:[^*/]|\*(?!/)|/(?!\*)|{_NESTED})*\*/"
_NESTED = rf"/\*(?:[^*/]|\*(?!/)|/(?!\*)|{_NESTED})*\*/"
_LEX = re.compile(
    rf'//[^\n]*|{_NESTED}|{_RAW}|[bc]?r"[^"]*"|[bc]?"(?:[^"\\]|\\.)*"|b?\'(?:[^\'\\\n]|\\(?:[nrt0\'"\\]|x[0-9a-fA-F]{{2}}|u\{{[0-9a-fA-F_]{{1,8}}\}}))\'|\'[^\W\d]\w*'
    r"|0[xXbBoO]\w+|[0-9][\w]*(?:\.[0-9]\w*|\.(?![.\w]))?(?:(?<=[eE])[+-][0-9]\w*)?|r#\w+|\w+|\.\.\.|\.\.=|\.\.|->|=>|::|<<=|>>=|==|!=|<=|>=|&&|\|\||[-+*/%&|^]=|\S",
    re.S,
)
_NUMBER = number(
    r"(?:0x[0-9a-fA-F_]*[0-9a-fA-F][0-9a-fA-F_]*?|0b[01_]*[01][01_]*|0o[0-7_]*[0-7][0-7_]*|[0-9][0-9_]*)(?:[iu](?:8|16|32|64|128|size))?|[0-9][0-9_]*(?:\.[0-9][0-9_]*)?(?:[eE][+-]?_*[0-9][0-9_]*)?(?:f(?:32|64))?|[0-9][0-9_]*\."
)
_WORDS = (
    "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while "
    "abstract become do final macro override priv typeof unsized virtual yield try gen union default macro_rules auto raw box _"
)
_MARKS = "( ) [ ] { } ; , . : = < > * & | ! # ? @ $ -> => :: ... .. ..= + - ^ ~ && || += -= *= /= %= &= |= ^= <<= >>= == != <= >= / %"


def _classify(text: str) -> str | None:
    c = text[0]
    if c == "/" and text[:2] in ("//", "/*"):
        return None if text[1] == "/" or (len(text) >= 4 and text.endswith("*/")) else "?!"
    if c == "'" or text[:2] == "b'":
        return "LIT" if len(text) > 2 and text[-1] == "'" else "LIFE" if len(text) > 1 and c == "'" else "?!"
    if c.isdigit():
        return "NUM" if _NUMBER(text) else "?!"
    if text[-1] == '"' and len(text) > 1 or (text[-1] == "#" and '"' in text):
        return "LIT"
    if text.startswith("r#"):
        return "ID"
    return "ID" if c == "_" or c.isalpha() else "?!"


_KINDS = Kinds(table(_WORDS, _MARKS) | {"true": "LIT", "false": "LIT"}, _classify)
_NAMES = frozenset("ID union default macro_rules auto raw box gen".split())
_SEGMENTS = _NAMES | frozenset("self Self super crate".split())
_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>=".split())
_BINARY = frozenset("+ - * / % ^ & | && || == != <= >=".split()) | _ASSIGN
_NO_OPERAND = frozenset(") ] } ; , =>".split()) | {END}
_BLOCKS = frozenset("{ if match while for loop unsafe async const LIFE".split())


class _Rust(Parser):
    def __init__(self, kinds: list[str]):
        super().__init__(kinds)
        self.bare = False  # in the head of if, while, for and match, where a brace opens the block

    # ---- items

    def file(self) -> None:
        k = self.k
        while k[self.p] == "#" and k[self.p + 1] == "!":
            self.attribute()
        while k[self.p] != END:
            if not self.item():
                self.fail()

    def attribute(self) -> None:
        self.p += 1
        self.has("!")
        if self.k[self.p] != "[":
            self.fail()
        self.p = self.match[self.p] + 1

    def attributes(self) -> None:
        while self.k[self.p] == "#":
            self.attribute()

    def visibility(self) -> None:
        if self.has("pub") and self.k[self.p] == "(" and self.k[self.p + 1] in ("crate", "self", "super", "in"):
            self.p = self.match[self.p] + 1

    def name(self) -> None:
        self.take_in(_NAMES)

    def item(self) -> bool:
        """An item with its attributes, if one stands here; else the cursor stays in front of the attributes."""
        k = self.k
        start = self.p
        self.attributes()
        self.visibility()
        p = self.p
        t, after = k[p], k[p + 1]
        if t == "fn":
            self.function(start)
        elif t in ("const", "async", "unsafe", "extern", "default", "auto") and self.function_ahead():
            while k[self.p] != "fn":
                self.p += 1
            self.function(start)
        elif t == "struct" or (t == "union" and after in _NAMES):
            self.struct()
        elif t == "enum":
            self.p += 1
            self.name()
            self.generics()
            self.where()
            self.take("{")
            self.all_in(self.match[self.p - 1], self.variant)
        elif t == "trait" or (t in ("unsafe", "auto") and after in ("trait", "auto")):
            while not self.has("trait"):
                self.p += 1
            self.name()
            self.generics()
            if self.has(":"):
                self.bounds()
            self.where()
            if self.has("="):
                self.bounds()
                self.take(";")
            else:
                self.members()
        elif t == "impl" or (t in ("unsafe", "default") and after == "impl"):
            self.implementation()
        elif t == "use":
            self.p += 1
            self.use()
            self.take(";")
        elif t == "mod" or (t == "unsafe" and after == "mod"):
            self.has("unsafe")
            self.p += 1
            self.name()
            if not self.has(";"):
                self.take("{")
                close = self.match[self.p - 1]
                while k[self.p] == "#" and k[self.p + 1] == "!":
                    self.attribute()
                while self.p < close:
                    if not self.item():
                        self.fail()
                self.p += 1
        elif t == "const" and (after in _NAMES or after == "_" or after == "mut"):
            self.p += 1
            if not self.has("_"):
                self.name()
            self.generics()
            self.take(":")
            self.type()
            if self.has("="):
                self.expr()
            self.take(";")
        elif t == "static" and (after in _NAMES or (after == "mut" and k[p + 2] in _NAMES) or after == "ref"):
            self.p += 1
            self.has("mut")
            self.name()
            self.take(":")
            self.type()
            if self.has("="):
                self.expr()
            self.take(";")
        elif t == "type" and after in _NAMES:
            self.alias()
        elif t == "extern" and after == "crate":
            self.p += 2
            self.take_in(_SEGMENTS)
            if self.has("as") and not self.has("_"):
                self.name()
            self.take(";")
        elif (t == "extern" and (after == "{" or (after == "LIT" and k[p + 2] == "{"))) or (t == "unsafe" and after == "extern"):
            self.has("unsafe")
            self.p += 1
            self.has("LIT")
            self.members()
        elif t == "macro_rules" and after == "!":
            self.p += 2
            self.name()
            self.tree()
        elif (t in _SEGMENTS or t == "::") and self.p_is_macro():
            self.path()
            self.p += 1
            braces = k[self.p] == "{"
            self.tree()
            if not braces:
                self.take(";")
        else:
            self.p = start
            return False
        return True

    def p_is_macro(self) -> bool:
        k, p = self.k, self.p
        if k[p] == "::":
            p += 1
        while k[p] in _SEGMENTS and k[p + 1] == "::":
            p += 2
        return k[p] in _SEGMENTS and k[p + 1] == "!" and k[p + 2] in ("(", "[", "{")

    def tree(self) -> None:
        if self.k[self.p] not in ("(", "[", "{"):
            self.fail()
        self.p = self.match[self.p] + 1

    def function_ahead(self) -> bool:
        k, p = self.k, self.p
        while k[p] in ("const", "async", "unsafe", "default") or k[p] == "extern":
            p += 2 if k[p] == "extern" and k[p + 1] == "LIT" else 1
        return k[p] == "fn"

    def function(self, first: int) -> None:
        self.p += 1
        name = self.p
        self.name()
        self.generics()
        self.take("(")
        self.all_in(self.match[self.p - 1], self.parameter)
        self.result()
        self.where()
        if not self.has(";"):
            self.block()
        self.found.append((name, first, self.p))

    def result(self) -> None:
        if self.has("->"):
            self.type()

    def parameter(self) -> None:
        k = self.k
        self.attributes()
        start = self.p
        if k[self.p] in ("&", "mut", "self"):
            self.has("&")
            self.has("LIFE")
            self.has("mut")
            if self.has("self"):
                if self.has(":"):
                    self.type()
                return
            self.p = start
        if self.has("..."):
            return
        self.pattern_top()
        self.take(":")
        if not self.has("..."):
            self.type()

    def generics(self) -> None:
        k = self.k
        if k[self.p] != "<":
            return
        self.p += 1
        while k[self.p] != ">":
            self.attributes()
            if self.has("LIFE"):
                if self.has(":"):
                    self.bounds()
            elif self.has("const"):
                self.name()
                self.take(":")
                self.type()
                if self.has("="):
                    self.generic_argument()
            else:
                self.name()
                if self.has(":"):
                    self.bounds()
                if self.has("="):
                    self.type()
            if not self.has(","):
                break
        self.take(">")

    def where(self) -> None:
        k = self.k
        if not self.has("where"):
            return
        while k[self.p] not in ("{", ";", "=", END):
            if not self.has("LIFE"):
                self.for_lifetimes()
                self.type()
            self.take(":")
            self.bounds()
            if not self.has(","):
                return

    def for_lifetimes(self) -> None:
        if self.k[self.p] == "for" and self.k[self.p + 1] == "<":
            self.p += 1
            self.generics()

    def bounds(self) -> None:
        k = self.k
        while k[self.p] in ("LIFE", "?", "~", "for", "(", "::", "const", "async", "use") or k[self.p] in _SEGMENTS:
            self.bound()
            if not self.has("+"):
                return

    def bound(self) -> None:
        k = self.k
        if self.has("LIFE"):
            return
        if k[self.p] == "(":
            close = self.match[self.p]
            self.p += 1
            self.bound()
            if self.p != close:
                self.fail()
            self.p += 1
            return
        if k[self.p] == "use" and k[self.p + 1] == "<":
            self.p += 1
            self.path_arguments()
            return
        if self.has("~"):
            self.take("const")
        self.has("?")
        self.for_lifetimes()
        self.has("async")
        self.path(types=True)

    def struct(self) -> None:
        k = self.k
        self.p += 1
        self.name()
        self.generics()
        if k[self.p] == "(":
            self.tuple_fields()
            self.where()
            self.take(";")
            return
        self.where()
        if k[self.p] == "{":
            self.fields()
        else:
            self.take(";")

    def tuple_fields(self) -> None:
        self.p += 1
        self.all_in(self.match[self.p - 1], self.tuple_field)

    def tuple_field(self) -> None:
        self.attributes()
        self.visibility()
        self.type()

    def fields(self) -> None:
        self.p += 1
        self.all_in(self.match[self.p - 1], self.field)

    def field(self) -> None:
        self.attributes()
        self.visibility()
        self.name()
        self.take(":")
        self.type()

    def variant(self) -> None:
        self.attributes()
        self.visibility()
        self.name()
        if self.k[self.p] == "(":
            self.tuple_fields()
        elif self.k[self.p] == "{":
            self.fields()
        if self.has("="):
            self.expr()

    def members(self) -> None:
        self.take("{")
        k, close = self.k, self.match[self.p - 1]
        while k[self.p] == "#" and k[self.p + 1] == "!":
            self.attribute()
        while self.p < close:
            if not self.item():
                self.fail()
        self.p += 1

    def implementation(self) -> None:
        k = self.k
        while not self.has("impl"):
            self.p += 1
        if k[self.p] == "<" and (k[self.p + 1] in _NAMES or k[self.p + 1] in (">", "LIFE", "const", "#")):
            self.generics()
        self.has("const")
        self.has("!")
        self.type()
        if self.has("for"):
            self.type()
        self.where()
        self.members()

    def alias(self) -> None:
        self.p += 1
        self.name()
        self.generics()
        if self.has(":"):
            self.bounds()
        self.where()
        if self.has("="):
            self.type()
            self.where()
        self.take(";")

    def use(self) -> None:
        k = self.k
        self.has("::")
        while True:
            if k[self.p] == "{":
                self.p += 1
                self.all_in(self.match[self.p - 1], self.use)
                return
            if self.has("*"):
                return
            self.take_in(_SEGMENTS)
            if not self.has("::"):
                break
        if self.has("as") and not self.has("_"):
            self.name()

    # ---- paths and types

    def path(self, types: bool = False) -> None:
        k = self.k
        if k[self.p] == "<":
            self.p += 1
            self.type()
            if self.has("as"):
                self.path(types=True)
            self.take(">")
            self.take("::")
        else:
            self.has("::")
        while True:
            self.take_in(_SEGMENTS)
            t = k[self.p]
            if types:
                if t == "<":
                    self.path_arguments()
                elif t == "(":
                    self.p += 1
                    self.all_in(self.match[self.p - 1], self.type)
                    if self.has("->"):
                        self.type(False)
                elif t == "::" and k[self.p + 1] == "<":
                    self.p += 1
                    self.path_arguments()
                elif t == "::" and k[self.p + 1] == "(":
                    self.p += 1
                    continue
            elif t == "::" and k[self.p + 1] == "<":
                self.p += 1
                self.path_arguments()
            if k[self.p] == "::" and k[self.p + 1] in _SEGMENTS:
                self.p += 1
            elif k[self.p] == "::" and not (types or k[self.p + 1] in ("{", "*")):
                self.fail()
            else:
                return

    def path_arguments(self) -> None:
        self.take("<")
        k = self.k
        while k[self.p] != ">":
            self.generic_argument()
            if not self.has(","):
                break
        if k[self.p] == ">=" or k[self.p] == ">>=":
            self.fail()
        self.take(">")

    def generic_argument(self) -> None:
        k = self.k
        t = k[self.p]
        if t == "LIFE" or t == "LIT" or t == "NUM":
            self.p += 1
        elif t == "-":
            self.p += 1
            self.take("NUM")
        elif t == "{":
            self.block()
        elif t in _NAMES and (k[self.p + 1] == "=" or k[self.p + 1] == ":"):
            self.p += 1
            if self.has("="):
                self.generic_argument()
            else:
                self.p += 1
                self.bounds()
        else:
            self.type()
            if self.has("="):
                self.type()
            elif self.has(":"):
                self.bounds()

    def type(self, plus: bool = True) -> None:
        k = self.k
        t = k[self.p]
        if t in _SEGMENTS or t == "::" or t == "<":
            self.path(types=True)
            if k[self.p] == "!" and k[self.p + 1] in ("(", "[", "{"):
                self.p += 1
                self.tree()
        elif t == "&" or t == "&&":
            self.p += 1
            self.has("LIFE")
            self.has("mut")
            self.type(False)
        elif t == "(":
            self.p += 1
            self.all_in(self.match[self.p - 1], self.type)
        elif t == "[":
            self.p += 1
            self.type()
            if self.has(";"):
                before, self.bare = self.bare, False
                self.expr()
                self.bare = before
            self.take("]")
        elif t == "*":
            self.p += 1
            if not self.has("const"):
                self.take("mut")
            self.type(False)
        elif t == "!" or t == "_":
            self.p += 1
        elif t == "dyn" or t == "impl":
            self.p += 1
            self.bound()
            while plus and self.has("+"):
                self.bound()
        elif t in ("fn", "unsafe", "extern", "for"):
            self.for_lifetimes()
            self.has("unsafe")
            if self.has("extern"):
                self.has("LIT")
            if k[self.p] != "fn":
                if t != "for":
                    self.fail()
                self.path(types=True)
                return
            self.p += 1
            self.take("(")
            self.all_in(self.match[self.p - 1], self.bare_parameter)
            if self.has("->"):
                self.type(False)
        else:
            self.fail()

    def bare_parameter(self) -> None:
        self.attributes()
        if self.has("..."):
            return
        if (self.k[self.p] in _NAMES or self.k[self.p] == "_") and self.k[self.p + 1] == ":":
            self.p += 2
        self.type()

    # ---- patterns

    def pattern(self) -> None:
        self.has("|")
        self.pattern_top()
        while self.has("|"):
            self.pattern_top()

    def pattern_top(self) -> None:
        k = self.k
        t = k[self.p]
        if t == "_":
            self.p += 1
        elif t == "LIT" or t == "NUM" or t == "-":
            self.literal()
            self.range_end()
        elif t == "&" or t == "&&":
            self.p += 1
            self.has("mut")
            self.pattern_top()
        elif t == "(" or t == "[":
            self.p += 1
            before, self.bare = self.bare, False
            self.all_in(self.match[self.p - 1], self.pattern)
            self.bare = before
        elif t == ".." or t == "..=":
            self.p += 1
            if k[self.p] in ("LIT", "NUM", "-"):
                self.literal()
        elif t == "ref" or t == "mut" or (t == "box" and k[self.p + 1] in _NAMES):
            self.p += 1
            self.has("mut")
            self.name()
            if self.has("@"):
                self.pattern_top()
        elif t == "const" and k[self.p + 1] == "{":
            self.p += 1
            self.block()
        elif t in _SEGMENTS or t == "::" or t == "<":
            if t in _NAMES and k[self.p + 1] == "@":
                self.p += 2
                self.pattern_top()
                return
            self.path()
            t = k[self.p]
            if t == "!" and k[self.p + 1] in ("(", "[", "{"):
                self.p += 1
                self.tree()
            elif t == "(":
                self.p += 1
                self.all_in(self.match[self.p - 1], self.pattern)
            elif t == "{":
                self.p += 1
                self.all_in(self.match[self.p - 1], self.field_pattern)
            else:
                self.range_end()
        else:
            self.fail()

    def literal(self) -> None:
        if self.has("-"):
            self.take("NUM")
        elif not self.has("LIT"):
            self.take("NUM")

    def range_end(self) -> None:
        k = self.k
        if k[self.p] in ("..=", "...", ".."):
            self.p += 1
            if k[self.p] in ("LIT", "NUM", "-"):
                self.literal()
            elif k[self.p] in _SEGMENTS or k[self.p] == "<":
                self.path()

    def field_pattern(self) -> None:
        k = self.k
        self.attributes()
        if self.has(".."):
            if k[self.p] != "}":
                self.fail()
            return
        if (k[self.p] in _NAMES or k[self.p] == "NUM") and k[self.p + 1] == ":":
            self.p += 2
            self.pattern()
            return
        self.has("box")
        self.has("ref")
        self.has("mut")
        self.name()

    # ---- statements

    def block(self) -> None:
        self.take("{")
        k, close = self.k, self.match[self.p - 1]
        before, self.bare = self.bare, False
        while k[self.p] == "#" and k[self.p + 1] == "!":
            self.attribute()
        while self.p < close:
            self.statement(close)
        self.bare = before
        self.p += 1

    def statement(self, close: int) -> None:
        k = self.k
        if self.has(";"):
            return
        start = self.p
        if k[start] == "#":
            self.attributes()
        t = k[self.p]
        if t == "let":
            self.p += 1
            name = self.p + 1 if k[self.p] == "mut" else self.p
            self.pattern()
            if self.p != name + 1:
                name = -1
            if self.has(":"):
                self.type()
            if self.has("="):
                function = k[self.p] in ("|", "||") or (k[self.p] == "move" and k[self.p + 1] in ("|", "||"))
                self.expr()
                if function and name > 0:
                    self.note(name, start)
                if self.has("else"):
                    self.block()
            self.take(";")
            return
        if t in _ITEMS or (t in _NAMES and k[self.p + 1] in ("!", "::")) or t in ("union", "auto", "macro_rules"):
            self.p = start
            if t in _NAMES and t not in ("union", "auto", "macro_rules"):
                # a macro: with braces it ends a statement, otherwise it is an expression
                if self.p_is_macro_at():
                    return
            elif self.item():
                return
        self.p = start
        self.attributes()
        if k[self.p] in _BLOCKS and self.block_like():
            if k[self.p] not in (".", "?"):
                return
            self.suffixes()
            self.rest()
        else:
            self.expr()
        if self.p < close:
            self.take(";")

    def p_is_macro_at(self) -> bool:
        """A macro call in braces that stands as a statement."""
        k, start = self.k, self.p
        self.attributes()
        if self.p_is_macro():
            self.path()
            self.p += 1
            if k[self.p] == "{":
                end = self.match[self.p] + 1
                if k[end] not in (".", "?"):
                    self.p = end
                    return True
        self.p = start
        return False

    def block_like(self) -> bool:
        """An expression that ends in a block, if one stands here."""
        k, p = self.k, self.p
        t = k[p]
        if t == "LIFE":
            if k[p + 1] != ":" or k[p + 2] not in ("{", "while", "for", "loop"):
                return False
            self.p += 2
            return self.block_like()
        if t == "{":
            self.block()
        elif t in ("unsafe", "const") and k[p + 1] == "{":
            self.p += 1
            self.block()
        elif t == "async" and (k[p + 1] == "{" or (k[p + 1] == "move" and k[p + 2] == "{")):
            self.p += 1
            self.has("move")
            self.block()
        elif t == "if":
            while True:
                self.p += 1
                self.condition()
                self.block()
                if not self.has("else"):
                    break
                if k[self.p] != "if":
                    self.block()
                    break
        elif t == "while":
            self.p += 1
            self.condition()
            self.block()
        elif t == "loop":
            self.p += 1
            self.block()
        elif t == "for" and k[p + 1] != "<":
            self.p += 1
            self.pattern()
            self.take("in")
            self.condition()
            self.block()
        elif t == "match":
            self.p += 1
            self.condition()
            self.take("{")
            close = self.match[self.p - 1]
            before, self.bare = self.bare, False
            while k[self.p] == "#" and k[self.p + 1] == "!":
                self.attribute()
            while self.p < close:
                self.arm(close)
            self.bare = before
            self.p += 1
        else:
            return False
        return True

    def arm(self, close: int) -> None:
        k = self.k
        self.attributes()
        self.pattern()
        if self.has("if"):
            self.expr()
        self.take("=>")
        if k[self.p] == "{":
            start = self.p
            self.block()
            if k[self.p] == ",":
                self.p += 1
                return
            if k[self.p] not in (".", "?"):
                return
            self.p = start
        self.expr()
        if self.p < close:
            if not self.has(",") and k[self.p - 1] != "}":
                self.fail()

    def condition(self) -> None:
        before, self.bare = self.bare, True
        self.expr()
        self.bare = before

    # ---- expressions

    def expr(self) -> None:
        k = self.k
        if k[self.p] in ("..", "..="):
            self.p += 1
            if not self.operand_ahead():
                return
        self.unary()
        self.rest()

    def operand_ahead(self) -> bool:
        t = self.k[self.p]
        return t not in _NO_OPERAND and not (t == "{" and self.bare) and t != "else"

    def rest(self) -> None:
        k = self.k
        while True:
            t = k[self.p]
            if t in _BINARY:
                self.p += 1
            elif t == "<" or t == ">":
                self.p += 1
                if k[self.p] == t and (t == ">" or k[self.p + 1] not in ("<",)):
                    self.p += 1
            elif t == "as":
                self.p += 1
                self.type(False)
                continue
            elif t == ".." or t == "..=":
                self.p += 1
                if not self.operand_ahead():
                    return
            else:
                return
            if k[self.p] in ("..", "..=") and t in _ASSIGN:
                self.expr()
                return
            self.unary()

    def unary(self) -> None:
        k = self.k
        while True:
            t = k[self.p]
            if t in ("-", "!", "*"):
                self.p += 1
            elif t == "&" or t == "&&":
                self.p += 1
                if k[self.p] == "raw" and k[self.p + 1] in ("const", "mut"):
                    self.p += 2
                else:
                    self.has("mut")
            else:
                break
        self.primary()
        self.suffixes()

    def suffixes(self) -> None:
        k = self.k
        while True:
            t = k[self.p]
            if t == ".":
                self.p += 1
                if k[self.p] == "NUM" or k[self.p] == "await":
                    self.p += 1
                else:
                    self.name()
                    if k[self.p] == "::":
                        self.p += 1
                        self.path_arguments()
                        if k[self.p] != "(":
                            self.fail()
            elif t == "(":
                self.p += 1
                self.inside(self.match[self.p - 1])
            elif t == "[":
                self.p += 1
                before, self.bare = self.bare, False
                self.expr()
                self.bare = before
                self.take("]")
            elif t == "?":
                self.p += 1
            else:
                return

    def inside(self, close: int) -> None:
        before, self.bare = self.bare, False
        self.all_in(close, self.argument)
        self.bare = before

    def argument(self) -> None:
        self.attributes()
        self.expr()

    def primary(self) -> None:
        k = self.k
        t = k[self.p]
        if t in _SEGMENTS or t == "::" or t == "<":
            self.path()
            t = k[self.p]
            if t == "!" and k[self.p + 1] in ("(", "[", "{"):
                self.p += 1
                self.tree()
            elif t == "{" and not self.bare and self.fields_ahead():
                self.p += 1
                before, self.bare = self.bare, False
                self.all_in(self.match[self.p - 1], self.field_value)
                self.bare = before
        elif t == "LIT" or t == "NUM":
            self.p += 1
        elif t == "(":
            self.p += 1
            self.inside(self.match[self.p - 1])
        elif t == "[":
            self.p += 1
            close = self.match[self.p - 1]
            before, self.bare = self.bare, False
            if self.p < close:
                self.argument()
                if self.has(";"):
                    self.expr()
                elif self.p < close:
                    self.take(",")
            self.all_in(close, self.argument)
            self.bare = before
        elif t in ("|", "||", "move", "static") or (t == "async" and k[self.p + 1] in ("|", "||", "move")) and k[self.p + 2] != "{":
            self.closure()
        elif t in ("return", "break", "yield"):
            self.p += 1
            if t == "break":
                self.has("LIFE")
            if self.operand_ahead():
                self.expr()
        elif t == "continue":
            self.p += 1
            self.has("LIFE")
        elif t == "let":
            self.p += 1
            self.pattern()
            self.take("=")
            before, self.bare = self.bare, True
            self.scrutinee()
            self.bare = before
        elif t == "_":
            self.p += 1
            if k[self.p] not in ("=", ",", ")", "]", "}"):
                self.fail()
        elif not self.block_like():
            self.fail()

    def scrutinee(self) -> None:
        """What a let in a condition looks at: no && or || of its own."""
        k = self.k
        self.unary()
        while k[self.p] in _BINARY and k[self.p] not in ("&&", "||") or k[self.p] in ("..", "..=", "as"):
            if self.has("as"):
                self.type(False)
            else:
                self.p += 1
                if self.operand_ahead():
                    self.unary()

    def fields_ahead(self) -> bool:
        k, p = self.k, self.p + 1
        return k[p] in ("}", "..", "#") or ((k[p] in _NAMES or k[p] == "NUM") and k[p + 1] in (":", ",", "}"))

    def field_value(self) -> None:
        k = self.k
        self.attributes()
        if self.has(".."):
            if k[self.p] != "}":
                self.expr()
            return
        if k[self.p] == "NUM":
            self.p += 1
            self.take(":")
            self.expr()
            return
        self.name()
        if self.has(":"):
            self.expr()

    def closure(self) -> None:
        k = self.k
        while k[self.p] in ("static", "async", "move"):
            self.p += 1
        if not self.has("||"):
            self.take("|")
            while k[self.p] != "|":
                self.attributes()
                self.pattern_top()
                if self.has(":"):
                    self.type()
                if not self.has(","):
                    break
            self.take("|")
        if self.has("->"):
            self.type(False)
            self.block()
        else:
            self.expr()


_ITEMS = frozenset("pub fn struct enum trait impl mod use const static type extern unsafe async".split())


def _after_shebang(text: str) -> str:
    if not text.startswith("#!") or text.startswith("#!["):
        return text
    end = text.find("\n")
    return " " * len(text) if end < 0 else " " * end + text[end:]


def parses(text: str) -> bool:
    """Whether the text is a source file."""
    text = _after_shebang(text)
    kinds = [kind for kind in map(_KINDS.__getitem__, _LEX.findall(text)) if kind is not None]
    if "?!" in kinds:
        return False
    try:
        _Rust(kinds).file()
        return True
    except (Refused, RecursionError):
        return False


def functions(text: str) -> tuple[list[Function], Source] | None:
    """The named functions of a source file and its tokens; None where the text is none."""
    tokens = source(_after_shebang(text), _LEX, _KINDS)
    if "?!" in tokens.kinds:
        return None
    try:
        parser = _Rust(tokens.kinds)
        parser.file()
    except (Refused, RecursionError):
        return None
    return named_functions(text, parser, tokens), tokens
