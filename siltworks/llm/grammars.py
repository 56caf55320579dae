"""Recognisers of six languages: does a text parse? Python by its own parser, the others by recursive descent over tokens.

Only the syntax counts: names and types are not looked up, and operator precedence plays no part, as an expression is a chain
of operands and operators whatever binds tighter. Every recogniser has a lexer of one pattern; comments and white space are
skipped, a character that starts no token is an error. Delimiters are matched before the descent, whose depth then follows the
nesting of the text without a limit of its own. Python is compiled, not only parsed, as a `return` outside a function is refused late;
where its compiler runs out of its own stack, the text counts as valid if its tokens are and its delimiters match.
"""

from __future__ import annotations

import io
import re
import sys
import tokenize
import warnings

_ID = r"(?:[^\W\d]|\$)(?:\w|\$)*"
_DQ, _SQ = r'"(?:[^"\\\n]|\\.|\\\n)*"', r"'(?:[^'\\\n]|\\.|\\\n)*'"
_NUM = r"(?:0[xX][0-9a-fA-F_']+[uUlLn]*|0[bB][01_']+[uUlLn]*|0[oO][0-7_]+n?|(?:\d[\d_']*(?:\.(?!\.)[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?(?:[uUiI](?:8|16|32|64|128|size)|f(?:32|64)|[uU]?[lL]{0,2}[uU]?|[fFdDnijr])?)(?!\w)"


class Bad(Exception):
    """The text does not parse."""


def _lexer(comments: str, strings: str, ops: str, ident: str = _ID) -> re.Pattern:
    by_length = sorted(ops.split(), key=len, reverse=True)
    return re.compile(
        rf"(?P<nl>\n)|(?P<skip>[ \t\r\f\v﻿]+|{comments})|(?P<str>{strings})|(?P<num>{_NUM})|(?P<id>{ident})|(?P<op>{'|'.join(map(re.escape, by_length))})", re.S
    )


class Parser:
    """The common part: tokens, delimiters and expression chains."""

    lexer: re.Pattern
    prefix: frozenset = frozenset("+ - ! ~ ++ -- & *".split())
    postfix: frozenset = frozenset(("++", "--"))
    binary: frozenset = frozenset("+ - * / % == != < > <= >= && || & | ^ << >> = += -= *= /= %= &= |= ^= <<= >>=".split())
    member: frozenset = frozenset((".",))
    reserved: frozenset = frozenset()
    values: frozenset = frozenset()  # reserved words that are operands
    split_angle = True

    def __init__(self, text: str, most: int | None = None):
        """With `most`, only so many tokens are cut and no end stands behind them: a rule that looks beyond raises IndexError."""
        self.kinds: list[str] = []
        self.toks: list[str] = []
        self.line: list[bool] = []  # a line end stands before
        self.most = most or len(text) + 1
        self.lex(text)
        self.whole = len(self.toks) < self.most
        for _ in range(3 if self.whole else 0):
            self.kinds.append("eof")
            self.toks.append("")
            self.line.append(True)
        self.i = 0

    def lex(self, text: str) -> None:
        match, at, end, fresh = self.lexer.match, 0, len(text), False
        kinds, toks, line = self.kinds, self.toks, self.line
        while at < end and len(toks) < self.most:
            m = match(text, at)
            if not m or m.end() == at:
                raise Bad(f"no token at {at}")
            kind = m.lastgroup
            at = m.end()
            if kind == "nl":
                fresh = True
            elif kind == "skip":
                fresh = fresh or "\n" in m[0]
            else:
                kinds.append(kind)
                toks.append(m[0])
                line.append(fresh)
                fresh = False

    # tokens
    def is_name(self, at: int = 0) -> bool:
        return self.kinds[self.i + at] == "id" and self.toks[self.i + at] not in self.reserved

    def accept(self, *options: str) -> bool:
        if self.toks[self.i] in options and self.kinds[self.i] in ("op", "id"):
            self.i += 1
            return True
        return False

    def at(self, *options: str) -> bool:
        return self.toks[self.i] in options and self.kinds[self.i] in ("op", "id")

    def expect(self, token: str) -> None:
        if self.toks[self.i] != token or self.kinds[self.i] not in ("op", "id"):
            raise Bad(f"{token} expected, found {self.toks[self.i]!r}")
        self.i += 1

    def name(self) -> str:
        if not self.is_name():
            raise Bad(f"name expected, found {self.toks[self.i]!r}")
        self.i += 1
        return self.toks[self.i - 1]

    def close_angle(self) -> None:
        """One `>`, also as the first half of a longer operator."""
        t = self.toks[self.i]
        if t == ">":
            self.i += 1
        elif t[:1] == ">" and self.kinds[self.i] == "op":
            self.toks[self.i] = t[1:]
        else:
            raise Bad("> expected")

    def attempt(self, rule, *args) -> bool:
        """Run a rule; on failure go back."""
        start, toks = self.i, None
        if ">>" in self.toks or ">>=" in self.toks or ">=" in self.toks or ">>>" in self.toks:
            toks = self.toks[:]
        try:
            rule(*args)
            return True
        except Bad:
            self.i = start
            if toks is not None:
                self.toks = toks
            return False

    def balanced(self) -> None:
        """A token tree: from an opening delimiter to the one that closes it."""
        pairs = {"(": ")", "[": "]", "{": "}"}
        stack = [pairs[self.toks[self.i]]]
        self.i += 1
        while stack:
            t, k = self.toks[self.i], self.kinds[self.i]
            if k == "eof":
                raise Bad("delimiter not closed")
            if k == "op":
                if t in pairs:
                    stack.append(pairs[t])
                elif t in (")", "]", "}"):
                    if stack.pop() != t:
                        raise Bad("delimiters do not match")
            self.i += 1

    def sequence(self, close: str, item, holes: bool = False) -> None:
        """Items with commas between them up to the closing token; a last comma is allowed."""
        while not self.accept(close):
            if holes and self.accept(","):
                continue
            item()
            if not self.accept(","):
                self.expect(close)
                return

    # expressions
    def expression(self) -> None:
        self.operand()
        while True:
            t = self.toks[self.i]
            if self.kinds[self.i] in ("op", "id") and t in self.binary:
                self.i += 1
                self.operand()
            elif t == "?" and self.kinds[self.i] == "op" and self.ternary():
                continue
            elif not self.more():
                return

    def more(self) -> bool:
        return False

    def ternary(self) -> bool:
        self.i += 1
        self.expression()
        self.expect(":")
        self.expression()
        return True

    def operand(self) -> None:
        while self.kinds[self.i] in ("op", "id") and self.toks[self.i] in self.prefix:
            self.i += 1
        self.primary()
        self.suffixes()

    def suffixes(self) -> None:
        while self.kinds[self.i] == "op" and self.suffix():
            pass

    def suffix(self) -> bool:
        t = self.toks[self.i]
        if t == "(":
            self.i += 1
            self.sequence(")", self.argument)
        elif t == "[":
            self.i += 1
            self.expression()
            self.expect("]")
        elif t in self.member:
            self.i += 1
            self.member_name()
        elif t in self.postfix:
            self.i += 1
        else:
            return False
        return True

    def member_name(self) -> None:
        if self.kinds[self.i] != "id":
            raise Bad("member expected")
        self.i += 1

    def argument(self) -> None:
        self.expression()

    def primary(self) -> None:
        k, t = self.kinds[self.i], self.toks[self.i]
        if k in ("num", "str") or (k == "id" and (t not in self.reserved or t in self.values)):
            self.i += 1
        elif t == "(":
            self.i += 1
            self.expression()
            self.expect(")")
        else:
            raise Bad(f"operand expected, found {t!r}")

    def program(self) -> None:
        raise NotImplementedError

    def run(self) -> None:
        self.program()
        if self.kinds[self.i] != "eof":
            raise Bad(f"end expected, found {self.toks[self.i]!r}")


def _words(text: str) -> frozenset:
    return frozenset(text.split())


class JavaScript(Parser):
    lexer = _lexer(
        r"//[^\n]*|/\*.*?\*/",
        rf"{_DQ}|{_SQ}|`(?:[^`\\]|\\.)*`",
        "{ } ( ) [ ] ; , < > <= >= == != === !== + - * / % ** ++ -- << >> >>> & | ^ ! ~ && || ?? ? ?. : = += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??= => . ... @ #",
    )
    prefix = _words("+ - ! ~ ++ -- typeof void delete await")
    binary = Parser.binary | _words("=== !== ** >>> ?? **= >>>= &&= ||= ??= in instanceof")
    member = frozenset((".", "?."))
    reserved = _words(
        "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum"
    )
    values = _words("this null true false super")
    _REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")

    def lex(self, text: str) -> None:
        match, at, end, fresh = self.lexer.match, 0, len(text), False
        kinds, toks, line = self.kinds, self.toks, self.line
        while at < end and len(toks) < self.most:
            m = match(text, at)
            if not m:
                raise Bad(f"no token at {at}")
            kind = m.lastgroup
            if kind == "op" and m[0] in ("/", "/="):
                last = (kinds[-1], toks[-1]) if kinds else ("op", "(")
                operand_before = last[0] in ("num", "str") or (last[0] == "id" and (last[1] not in self.reserved or last[1] in self.values)) or last[1] in (")", "]", "}")
                if not operand_before and (r := self._REGEX.match(text, at)):
                    m, kind = r, "str"
            at = m.end()
            if kind == "nl":
                fresh = True
            elif kind == "skip":
                fresh = fresh or "\n" in m[0]
            else:
                kinds.append(kind)
                toks.append(m[0])
                line.append(fresh)
                fresh = False

    def program(self) -> None:
        while self.kinds[self.i] != "eof":
            self.statement()

    def end(self) -> None:
        if self.accept(";") or self.at("}") or self.kinds[self.i] == "eof" or self.line[self.i]:
            return
        raise Bad(f"end of statement expected, found {self.toks[self.i]!r}")

    def block(self) -> None:
        self.expect("{")
        while not self.accept("}"):
            if self.kinds[self.i] == "eof":
                raise Bad("block not closed")
            self.statement()

    def comma_expression(self) -> None:
        self.expression()
        while self.accept(","):
            self.expression()

    def pattern(self) -> None:
        if self.at("{", "["):
            self.primary()
        else:
            self.name()

    def bindings(self, loop: bool = False) -> None:
        while True:
            self.pattern()
            if self.accept("="):
                self.expression()
            if not self.accept(","):
                return

    def statement(self) -> None:
        t = self.toks[self.i]
        if self.kinds[self.i] == "op":
            if t == "{":
                return self.block()
            if t == ";":
                self.i += 1
                return None
        if self.kinds[self.i] == "id":
            if t == "function" or (t == "async" and self.toks[self.i + 1] == "function" and not self.line[self.i + 1]):
                return self.function(True)
            if t == "class":
                return self.klass(True)
            if t in ("var", "const") or (t == "let" and (self.kinds[self.i + 1] == "id" or self.toks[self.i + 1] in ("[", "{"))):
                self.i += 1
                self.bindings()
                return self.end()
            rule = self.RULES.get(t)
            if rule:
                self.i += 1
                return rule(self)
            if t not in self.reserved and self.toks[self.i + 1] == ":" and self.kinds[self.i + 1] == "op":
                self.i += 2
                return self.statement()
        self.comma_expression()
        return self.end()

    def condition(self) -> None:
        self.expect("(")
        self.comma_expression()
        self.expect(")")

    def s_if(self) -> None:
        self.condition()
        self.statement()
        if self.accept("else"):
            self.statement()

    def s_while(self) -> None:
        self.condition()
        self.statement()

    def s_do(self) -> None:
        self.statement()
        self.expect("while")
        self.condition()
        self.accept(";")

    def s_for(self) -> None:
        self.accept("await")
        self.expect("(")
        if not self.accept(";"):
            if self.at("var", "const", "let"):
                self.i += 1
                self.pattern()
                if self.accept("of", "in"):
                    self.comma_expression()
                    self.expect(")")
                    return self.statement()
                if self.accept("="):
                    self.expression()
                if self.accept(","):
                    self.bindings()
            else:
                self.comma_expression()
                if self.accept("of"):
                    self.comma_expression()
                if self.accept(")"):
                    return self.statement()
            self.expect(";")
        if not self.at(";"):
            self.comma_expression()
        self.expect(";")
        if not self.at(")"):
            self.comma_expression()
        self.expect(")")
        return self.statement()

    def s_return(self) -> None:
        if not (self.at(";", "}") or self.line[self.i] or self.kinds[self.i] == "eof"):
            self.comma_expression()
        self.end()

    def s_jump(self) -> None:
        if self.is_name() and not self.line[self.i]:
            self.i += 1
        self.end()

    def s_throw(self) -> None:
        self.comma_expression()
        self.end()

    def s_try(self) -> None:
        self.block()
        caught = self.accept("catch")
        if caught:
            if self.accept("("):
                self.pattern()
                self.expect(")")
            self.block()
        if self.accept("finally"):
            self.block()
        elif not caught:
            raise Bad("try without catch")

    def s_switch(self) -> None:
        self.condition()
        self.expect("{")
        while not self.accept("}"):
            if self.accept("case"):
                self.comma_expression()
            else:
                self.expect("default")
            self.expect(":")
            while not self.at("case", "default", "}"):
                if self.kinds[self.i] == "eof":
                    raise Bad("switch not closed")
                self.statement()

    def s_import(self) -> None:
        if self.at("("):
            self.i -= 1
            self.comma_expression()
            return self.end()
        if self.kinds[self.i] != "str":
            if self.is_name():
                self.i += 1
                self.accept(",")
            if self.accept("*"):
                self.expect("as")
                self.name()
            elif self.at("{"):
                self.balanced()
            self.expect("from")
        if self.kinds[self.i] != "str":
            raise Bad("module expected")
        self.i += 1
        return self.end()

    def s_export(self) -> None:
        if self.accept("default"):
            if self.at("function", "class", "async"):
                return self.statement()
            self.expression()
            return self.end()
        if self.at("{", "*"):
            if self.at("{"):
                self.balanced()
            else:
                self.i += 1
                if self.accept("as"):
                    self.name()
            if self.accept("from"):
                if self.kinds[self.i] != "str":
                    raise Bad("module expected")
                self.i += 1
            return self.end()
        if not self.at("var", "let", "const", "function", "class", "async"):
            raise Bad("export")
        return self.statement()

    def s_debugger(self) -> None:
        self.end()

    RULES = dict(
        **{"if": s_if, "while": s_while, "do": s_do, "for": s_for, "return": s_return, "break": s_jump, "continue": s_jump, "throw": s_throw},
        **{"try": s_try, "switch": s_switch, "import": s_import, "export": s_export, "debugger": s_debugger},
    )

    def parameters(self) -> None:
        self.expect("(")

        def one() -> None:
            self.accept("...")
            self.pattern()
            if self.accept("="):
                self.expression()

        self.sequence(")", one)

    def function(self, named: bool) -> None:
        self.accept("async")
        self.expect("function")
        self.accept("*")
        if self.is_name():
            self.i += 1
        elif named and self.toks[self.i - 2] != "default":
            raise Bad("function name")
        self.parameters()
        self.block()

    def klass(self, named: bool) -> None:
        self.expect("class")
        if self.is_name():
            self.i += 1
        if self.accept("extends"):
            self.operand()
        self.expect("{")
        while not self.accept("}"):
            if self.accept(";"):
                continue
            while self.at("static", "async", "get", "set", "*") and self.toks[self.i + 1] not in ("(", "=", ";"):
                self.i += 1
            if self.at("{"):
                self.block()
                continue
            self.key()
            if self.at("("):
                self.parameters()
                self.block()
            else:
                if self.accept("="):
                    self.expression()
                self.end()

    def key(self) -> None:
        if self.accept("["):
            self.expression()
            self.expect("]")
        else:
            self.accept("#")
            if self.kinds[self.i] not in ("id", "str", "num"):
                raise Bad("key expected")
            self.i += 1

    def member_name(self) -> None:
        if self.toks[self.i - 1] == "?." and self.at("(", "["):
            return
        self.accept("#")
        super().member_name()

    def suffix(self) -> bool:
        t = self.toks[self.i]
        if t in ("++", "--") and self.line[self.i]:
            return False
        if t == "[":
            self.i += 1
            self.comma_expression()
            self.expect("]")
            return True
        return super().suffix()

    def suffixes(self) -> None:
        while (self.kinds[self.i] == "op" and self.suffix()) or (self.kinds[self.i] == "str" and self.toks[self.i][0] == "`" and self.skip()):
            pass

    def skip(self) -> bool:
        self.i += 1
        return True

    def argument(self) -> None:
        self.accept("...")
        self.expression()

    def arrow_body(self) -> None:
        self.expect("=>")
        if self.at("{"):
            self.block()
        else:
            self.expression()

    def primary(self) -> None:
        k, t = self.kinds[self.i], self.toks[self.i]
        if k == "id":
            if t == "function" or (t == "async" and self.toks[self.i + 1] == "function"):
                return self.function(False)
            if t == "class":
                return self.klass(False)
            if t == "new":
                self.i += 1
                if self.accept("."):
                    return self.member_name()
                return self.primary()
            if t == "import" and self.toks[self.i + 1] in ("(", "."):
                self.i += 1
                return None
            if t == "async" and self.toks[self.i + 1] == "(":
                start = self.i
                self.i += 1
                if self.attempt(lambda: (self.parameters(), self.arrow_body())):
                    return None
                self.i = start
            elif t == "async" and self.kinds[self.i + 1] == "id" and self.toks[self.i + 2] == "=>":
                self.i += 1
            if t == "yield":
                self.i += 1
                self.accept("*")
                if not self.at(")", "]", "}", ",", ";") and not self.line[self.i]:
                    self.expression()
                return None
            if self.is_name() and self.toks[self.i + 1] == "=>":
                self.i += 1
                return self.arrow_body()
        elif t == "(":
            depth, j = 0, self.i
            while True:
                x = self.toks[j]
                if self.kinds[j] == "eof":
                    raise Bad("( not closed")
                if self.kinds[j] == "op":
                    depth += (x in ("(", "[", "{")) - (x in (")", "]", "}"))
                    if not depth:
                        break
                j += 1
            if self.toks[j + 1] == "=>":
                self.parameters()
                return self.arrow_body()
            self.i += 1
            self.comma_expression()
            return self.expect(")")
        elif t == "[":
            self.i += 1
            return self.sequence("]", self.argument, holes=True)
        elif t == "{":
            self.i += 1
            return self.sequence("}", self.property)
        return super().primary()

    def property(self) -> None:
        if self.accept("..."):
            return self.expression()
        while self.at("async", "get", "set", "*") and self.toks[self.i + 1] not in ("(", ":", ",", "}", "="):
            self.i += 1
        shorthand = self.is_name()
        self.key()
        if self.at("("):
            self.parameters()
            return self.block()
        if self.accept(":"):
            return self.expression()
        if not shorthand:
            raise Bad("value expected")
        if self.accept("="):
            self.expression()
        return None


class CLike(Parser):
    """What Java and C++ share: declarations against expressions, statements with semicolons."""

    def block(self) -> None:
        self.expect("{")
        while not self.accept("}"):
            if self.kinds[self.i] == "eof":
                raise Bad("block not closed")
            self.statement()

    def condition(self) -> None:
        self.expect("(")
        self.expression()
        self.expect(")")

    def s_if(self) -> None:
        self.condition()
        self.statement()
        if self.accept("else"):
            self.statement()

    def s_while(self) -> None:
        self.condition()
        self.statement()

    def s_do(self) -> None:
        self.statement()
        self.expect("while")
        self.condition()
        self.expect(";")

    def s_return(self) -> None:
        if not self.at(";"):
            self.expression()
        self.expect(";")

    def s_jump(self) -> None:
        if self.is_name():
            self.i += 1
        self.expect(";")

    def s_for(self) -> None:
        self.expect("(")
        if not self.accept(";"):
            if self.attempt(self.each):
                self.expect(")")
                return self.statement()
            if not self.attempt(self.declaration):
                self.expressions()
                self.expect(";")
        if not self.at(";"):
            self.expression()
        self.expect(";")
        if not self.at(")"):
            self.expressions()
        self.expect(")")
        return self.statement()

    def each(self) -> None:
        self.type()
        self.declared_name()
        self.expect(":")
        self.expression()
        if not self.at(")"):
            raise Bad(") expected")

    def declared_name(self) -> None:
        self.name()

    def expressions(self) -> None:
        self.expression()
        while self.accept(","):
            self.expression()

    def s_switch(self) -> None:
        self.condition()
        self.expect("{")
        while not self.accept("}"):
            if self.accept("case"):
                self.case_label()
            else:
                self.expect("default")
            if self.accept("->"):
                if self.at("{", "throw"):
                    self.statement()
                else:
                    self.expression()
                    self.expect(";")
                continue
            self.expect(":")
            while not self.at("case", "default", "}"):
                if self.kinds[self.i] == "eof":
                    raise Bad("switch not closed")
                self.statement()

    def case_label(self) -> None:
        while True:
            self.operand()
            while self.toks[self.i] in self.binary and self.kinds[self.i] == "op":
                self.i += 1
                self.operand()
            if not self.accept(","):
                return

    def declaration(self) -> None:
        self.type()
        while True:
            self.declared_name()
            self.initialiser()
            if not self.accept(","):
                break
        self.expect(";")

    def statement(self) -> None:
        k, t = self.kinds[self.i], self.toks[self.i]
        if k == "op":
            if t == "{":
                return self.block()
            if t == ";":
                self.i += 1
                return None
        elif k == "id":
            rule = self.RULES.get(t)
            if rule:
                self.i += 1
                return rule(self)
            if self.toks[self.i + 1] == ":" and self.is_name():
                self.i += 2
                return self.statement()
            if self.local_type():
                return None
            n = self.toks[self.i + 1]
            plain = self.kinds[self.i + 1] == "op" and n not in ("<", "[", "::", ".", "*", "&", "&&")
            if not plain and self.attempt(self.declaration):
                return None
        self.expression_statement()
        return None

    def expression_statement(self) -> None:
        self.expressions()
        self.expect(";")

    def local_type(self) -> bool:
        return False

    RULES = {"if": s_if, "while": s_while, "do": s_do, "for": s_for, "return": s_return, "break": s_jump, "continue": s_jump, "switch": s_switch}


class Java(CLike):
    lexer = _lexer(
        r"//[^\n]*|/\*.*?\*/",
        rf'"""[ \t]*\r?\n(?:[^"\\]|\\.|"(?!""))*"""|{_DQ}|{_SQ}',
        "{ } ( ) [ ] ; , . ... @ :: = > < ! ~ ? : -> == >= <= != && || ++ -- + - * / & | ^ % << >> >>> += -= *= /= &= |= ^= %= <<= >>= >>>=",
    )
    prefix = _words("+ - ! ~ ++ --")
    binary = Parser.binary | _words(">>> >>>= instanceof")
    reserved = _words(
        "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null"
    )
    values = _words("this super true false null")
    basic = _words("boolean byte char short int long float double void")
    modifiers = _words("public private protected static final abstract native synchronized transient volatile strictfp default sealed")

    def program(self) -> None:
        self.annotations()
        if self.accept("package"):
            self.dotted()
            self.expect(";")
        while self.at("import", ";"):
            if self.accept(";"):
                continue
            self.i += 1
            self.accept("static")
            self.dotted(True)
            self.expect(";")
        while self.kinds[self.i] != "eof":
            if self.accept(";"):
                continue
            self.skip_modifiers()
            if not self.type_body():
                raise Bad("type expected")

    def dotted(self, star: bool = False) -> None:
        self.name()
        while self.accept("."):
            if star and self.accept("*"):
                return
            self.name()

    def annotations(self) -> None:
        while self.at("@") and self.toks[self.i + 1] != "interface":
            self.i += 1
            self.dotted()
            if self.at("("):
                self.balanced()

    def skip_modifiers(self) -> None:
        while True:
            self.annotations()
            if self.at(*self.modifiers):
                self.i += 1
            elif self.at("non") and self.toks[self.i + 1] == "-":
                self.i += 3
            else:
                return

    def type_body(self) -> bool:
        if self.at("class", "interface", "enum") or self.at("@") or (self.at("record") and self.kinds[self.i + 1] == "id" and self.toks[self.i + 2] in ("(", "<")):
            kind = self.toks[self.i]
            self.i += 1
            if kind == "@":
                self.expect("interface")
            own = self.name()
            if self.at("<"):
                self.type_parameters()
            if kind == "record":
                self.parameters()
            while self.accept("extends", "implements", "permits"):
                self.type()
                while self.accept(","):
                    self.type()
            self.expect("{")
            if kind == "enum":
                self.constants()
            self.members(own)
            return True
        return False

    def constants(self) -> None:
        while not self.at("}", ";"):
            self.annotations()
            self.name()
            if self.accept("("):
                self.sequence(")", self.argument)
            if self.accept("{"):
                self.members("")
            if not self.accept(","):
                break
        if not self.at("}"):
            self.expect(";")

    def type_parameters(self) -> None:
        self.expect("<")
        while True:
            self.annotations()
            self.name()
            if self.accept("extends"):
                self.type()
                while self.accept("&"):
                    self.type()
            if not self.accept(","):
                break
        self.close_angle()

    def members(self, own: str) -> None:
        while not self.accept("}"):
            if self.kinds[self.i] == "eof":
                raise Bad("type not closed")
            if self.accept(";"):
                continue
            if self.at("{") or (self.at("static") and self.toks[self.i + 1] == "{"):
                self.accept("static")
                self.block()
                continue
            self.skip_modifiers()
            if self.type_body():
                continue
            if self.at("<"):
                self.type_parameters()
            if self.at(own) and self.toks[self.i + 1] in ("(", "{"):
                self.i += 1
                if self.at("("):
                    self.parameters()
                self.throws()
                self.block()
                continue
            self.type()
            self.name()
            if self.at("("):
                self.parameters()
                self.brackets()
                self.throws()
                if self.accept("default"):
                    self.expression()
                if not self.accept(";"):
                    self.block()
                continue
            self.initialiser()
            while self.accept(","):
                self.name()
                self.initialiser()
            self.expect(";")

    def throws(self) -> None:
        if self.accept("throws"):
            self.type()
            while self.accept(","):
                self.type()

    def parameters(self) -> None:
        self.expect("(")

        def one() -> None:
            self.skip_modifiers()
            self.type()
            self.accept("...")
            if not self.accept("this"):
                self.name()
            self.brackets()

        if self.accept(")"):
            return
        while True:
            one()
            if not self.accept(","):
                break
        self.expect(")")

    def brackets(self) -> None:
        while self.at("[") and self.toks[self.i + 1] == "]":
            self.i += 2

    def type(self) -> None:
        self.annotations()
        while self.accept("final"):
            pass
        self.annotations()
        if self.at(*self.basic):
            self.i += 1
        else:
            while True:
                self.name()
                if self.at("<"):
                    self.type_arguments()
                if not (self.at(".") and self.kinds[self.i + 1] == "id"):
                    break
                self.i += 1
        self.brackets()

    def type_arguments(self) -> None:
        self.expect("<")
        if self.at(">"):
            self.i += 1
            return
        while True:
            if self.accept("?"):
                if self.accept("extends", "super"):
                    self.type()
            else:
                self.type()
            if not self.accept(","):
                break
        self.close_angle()

    def initialiser(self) -> None:
        self.brackets()
        if self.accept("="):
            self.value()

    def value(self) -> None:
        if self.accept("{"):
            self.sequence("}", self.value)
        else:
            self.expression()

    def local_type(self) -> bool:
        if self.at("class", "interface", "enum", "abstract", "static", "final", "record"):
            start = self.i
            self.skip_modifiers()
            if self.type_body():
                return True
            self.i = start
        return False

    def s_try(self) -> None:
        closing = self.at("(")
        if closing:
            self.i += 1
            while not self.accept(")"):
                if not self.attempt(lambda: (self.type(), self.name(), self.initialiser())):
                    self.expression()
                if not self.accept(";"):
                    self.expect(")")
                    break
        self.block()
        some = closing
        while self.accept("catch"):
            some = True
            self.expect("(")
            self.type()
            while self.accept("|"):
                self.type()
            self.name()
            self.expect(")")
            self.block()
        if self.accept("finally"):
            self.block()
        elif not some:
            raise Bad("try without catch")

    def statement(self) -> None:
        if self.at("yield") and not (self.kinds[self.i + 1] == "op" and self.toks[self.i + 1] in ("=", ".", "(", "[", "++", "--", ";")):
            self.i += 1
            self.expression()
            return self.expect(";")
        return super().statement()

    def operand(self) -> None:
        if self.toks[self.i - 1] == "instanceof" and self.i:
            self.accept("final")
            self.type()
            if self.at("("):
                self.balanced()
            if self.is_name():
                self.i += 1
            return
        super().operand()

    def s_throw(self) -> None:
        self.expression()
        self.expect(";")

    def s_assert(self) -> None:
        self.expression()
        if self.accept(":"):
            self.expression()
        self.expect(";")

    def s_synchronized(self) -> None:
        self.condition()
        self.block()

    RULES = CLike.RULES | {"try": s_try, "throw": s_throw, "assert": s_assert, "synchronized": s_synchronized}

    def expression_statement(self) -> None:
        start = self.i
        self.expression()
        self.expect(";")
        # only assignments, calls, steps and creations are statements
        body = self.toks[start : self.i - 1]
        if not (body[-1] in (")", "++", "--", "}", "]") or body[0] in ("++", "--", "new") or any(t in ASSIGN for t in body)):
            raise Bad("not a statement")

    def member_name(self) -> None:
        if self.at("<"):
            self.type_arguments()
        if self.accept("new"):
            self.type()
            return
        super().member_name()

    def suffix(self) -> bool:
        if self.at("::"):
            self.i += 1
            if not self.accept("new"):
                self.name()
            return True
        return super().suffix()

    def more(self) -> bool:
        return False

    def primary(self) -> None:
        k, t = self.kinds[self.i], self.toks[self.i]
        if t == "(" and k == "op":
            if self.attempt(self.lambda_):
                return None
            if self.attempt(self.cast):
                return None
        elif k == "id":
            if t == "new":
                self.i += 1
                self.annotations()
                if self.at(*self.basic):
                    self.i += 1
                else:
                    while True:
                        self.name()
                        if self.at("<"):
                            self.type_arguments()
                        if not self.accept("."):
                            break
                if self.accept("("):
                    self.sequence(")", self.argument)
                    if self.accept("{"):
                        self.members("")
                elif self.at("["):
                    while self.accept("["):
                        if not self.accept("]"):
                            self.expression()
                            self.expect("]")
                    if self.accept("{"):
                        self.sequence("}", self.value)
                else:
                    raise Bad("new")
                return None
            if t == "switch":
                self.i += 1
                return self.s_switch()
            if self.is_name() and self.toks[self.i + 1] == "->":
                self.i += 1
                return self.lambda_body()
            if t in self.basic:
                self.i += 1
                self.brackets()
                if not self.at(".", "::"):
                    raise Bad("type as operand")
                if self.accept("."):
                    self.expect("class")
                return None
            if self.is_name() and self.toks[self.i + 1] in ("<", "["):
                start = self.i
                if self.attempt(lambda: (self.type(), self.at("::") or self.fail())):
                    return None
                self.i = start
        return super().primary()

    def fail(self) -> None:
        raise Bad("no")

    def lambda_body(self) -> None:
        self.expect("->")
        if self.at("{"):
            self.block()
        else:
            self.expression()

    def lambda_(self) -> None:
        self.expect("(")
        if not self.accept(")"):
            while True:
                if self.is_name() and self.toks[self.i + 1] in (",", ")"):
                    self.i += 1
                else:
                    self.type()
                    self.name()
                if not self.accept(","):
                    break
            self.expect(")")
        self.lambda_body()

    def cast(self) -> None:
        self.expect("(")
        basic = self.at(*self.basic)
        self.type()
        while self.accept("&"):
            self.type()
        self.expect(")")
        if not basic and not (self.kinds[self.i] in ("id", "num", "str") or self.at("(", "!", "~")):
            raise Bad("not a cast")
        if self.kinds[self.i] == "id" and self.at("instanceof"):
            raise Bad("not a cast")
        self.operand()


ASSIGN = _words("= += -= *= /= %= &= |= ^= <<= >>= >>>=")


class Cpp(CLike):
    lexer = _lexer(
        r"//(?:[^\n\\]|\\\r?\n|\\.)*|/\*.*?\*/",
        rf'(?:u8|[uUL])?R"(?P<tag>[^()\\ ]{{0,16}})\(.*?\)(?P=tag)"|(?:u8|[uUL])?{_DQ}|[uUL]?{_SQ}',
        "{ } ( ) [ ] ; : :: , . ... .* ->* -> ? + - * / % ^ & | ~ ! = < > += -= *= /= %= ^= &= |= << >> <<= >>= == != <= >= <=> && || ++ -- # ##",
    )
    prefix = _words("+ - ! ~ ++ -- & * && co_await throw")
    binary = Parser.binary | _words("<=> .* ->* and or bitand bitor xor")
    member = frozenset((".", "->"))
    reserved = _words(
        "alignas asm auto bool break case catch char class const constexpr const_cast continue decltype default delete do double dynamic_cast else enum explicit export extern false float for friend goto if inline int long mutable namespace new noexcept nullptr operator private protected public register reinterpret_cast return short signed sizeof static static_assert static_cast struct switch template this thread_local throw true try typedef typeid typename union unsigned using virtual void volatile while"
    )
    values = _words("this true false nullptr")
    basic = _words("void bool char short int long float double signed unsigned auto wchar_t char8_t char16_t char32_t")
    specifiers = _words("const volatile static inline constexpr extern mutable register thread_local virtual explicit friend typename consteval constinit typedef struct class enum union")
    _DIRECTIVE = re.compile(r"[ \t]*#[ \t]*(include[ \t]*(?:<[^>\n]+>|\"[^\"\n]+\")|(?:define|undef|ifdef|ifndef)[ \t]+\w+|(?:if|elif|pragma|error|warning|line)\b|(?:else|endif)\b|(?=\r?\n|$))(?:[^\n\\]|\\\r?\n|\\.)*")

    def lex(self, text: str) -> None:
        # directives are whole lines; they are checked and blanked before the tokens are cut
        if "#" in text:
            hidden = re.sub(r"//(?:[^\n\\]|\\\r?\n|\\.)*|/\*.*?\*/|" + _DQ, lambda m: re.sub(r"[^\n]", "a" if m[0][0] == '"' else " ", m[0]), text, flags=re.S)
            out, at, depth = [], 0, 0
            for raw in re.finditer(r"^[ \t]*#(?:[^\n\\]|\\\r?\n|\\.)*", hidden, re.M):
                line = text[raw.start() : raw.end()]
                m = self._DIRECTIVE.match(line)
                if not m:
                    raise Bad("directive")
                word = m[1]
                depth += word.startswith("if") - word.startswith("endif")
                if depth < 0:
                    raise Bad("#endif without #if")
                out.append(text[at : raw.start()])
                out.append("\n" * line.count("\n"))
                at = raw.end()
            if depth:
                raise Bad("#if not closed")
            out.append(text[at:])
            text = "".join(out)
        super().lex(text)

    def program(self) -> None:
        while self.kinds[self.i] != "eof":
            self.external()

    def attributes(self) -> None:
        while self.at("[") and self.toks[self.i + 1] == "[":
            self.balanced()
        if self.at("alignas"):
            self.i += 1
            self.balanced()

    def external(self) -> None:
        self.attributes()
        if self.accept(";"):
            return
        if self.accept("namespace") or (self.at("inline") and self.toks[self.i + 1] == "namespace" and not self.skip(2)):
            while self.is_name():
                self.i += 1
                self.accept("::")
            if self.accept("="):
                self.type()
                return self.expect(";")
            return self.group()
        if self.at("extern") and self.kinds[self.i + 1] == "str":
            self.i += 2
            if self.at("{"):
                return self.group()
            return self.external()
        if self.accept("template"):
            if self.at("<"):
                self.template_parameters()
            if self.accept("requires"):
                self.expression()
            return self.external()
        if self.accept("using"):
            return self.using()
        if self.accept("static_assert"):
            self.balanced()
            return self.expect(";")
        if self.at("asm"):
            self.i += 1
            self.balanced()
            return self.expect(";")
        return self.declare("")

    def skip(self, n: int) -> bool:
        self.i += n
        return False

    def group(self) -> None:
        self.expect("{")
        while not self.accept("}"):
            if self.kinds[self.i] == "eof":
                raise Bad("not closed")
            self.external()

    def using(self) -> None:
        self.accept("namespace")
        self.accept("typename")
        self.type()
        if self.accept("="):
            self.type()
            self.abstract()
        self.expect(";")

    def template_parameters(self) -> None:
        self.expect("<")
        if self.at(">"):
            self.i += 1
            return
        while True:
            if self.accept("class", "typename"):
                self.accept("...")
                if self.is_name():
                    self.i += 1
                if self.accept("="):
                    self.type()
            elif self.accept("template"):
                self.template_parameters()
                self.i += 1
                if self.is_name():
                    self.i += 1
            else:
                self.type()
                self.accept("...")
                if self.is_name():
                    self.i += 1
                if self.accept("="):
                    self.operand()
            if not self.accept(","):
                break
        self.close_angle()

    def aggregate(self) -> bool:
        """struct, class, union or enum with a body."""
        j = self.i + 1
        if self.toks[self.i] == "enum" and self.toks[j] in ("class", "struct"):
            j += 1
        own = ""
        while self.kinds[j] == "id" and self.toks[j] not in self.reserved:
            own = self.toks[j]
            j += 1
        if self.toks[j] not in ("{", ":"):
            return False
        enum = self.toks[self.i] == "enum"
        self.i = j
        if self.accept(":"):
            while True:
                while self.accept("public", "private", "protected", "virtual"):
                    pass
                self.type()
                if not self.accept(","):
                    break
        self.expect("{")
        if enum:

            def one() -> None:
                self.name()
                if self.accept("="):
                    self.expression()

            self.sequence("}", one)
            return True
        while not self.accept("}"):
            if self.kinds[self.i] == "eof":
                raise Bad("not closed")
            if self.at("public", "private", "protected"):
                self.i += 1
                self.expect(":")
            else:
                self.inner(own)
        return True

    def inner(self, own: str) -> None:
        self.attributes()
        if self.accept(";"):
            return
        if self.accept("template"):
            self.template_parameters()
            return self.inner(own)
        if self.accept("using"):
            return self.using()
        if self.accept("static_assert"):
            self.balanced()
            return self.expect(";")
        return self.declare(own)

    def declare(self, own: str) -> None:
        """A declaration outside functions: variables, functions, types."""
        start = self.i
        while self.at("static", "inline", "constexpr", "virtual", "explicit", "friend", "extern", "typedef", "const"):
            self.i += 1
        if self.at("struct", "class", "union", "enum") and self.aggregate():
            if self.accept(";"):
                return
            self.declarators(False)
            return
        constructor = (own and self.at(own) and self.toks[self.i + 1] == "(") or (self.at("~") and self.kinds[self.i + 1] == "id")
        outside = self.is_name() and self.toks[self.i + 1] == "::" and (self.toks[self.i + 2] == "~" or (self.toks[self.i + 2] == self.toks[self.i] and self.toks[self.i + 3] == "("))
        if outside:
            self.i += 2
        if constructor or outside:
            self.accept("~")
            self.i += 1
            self.parameters()
            return self.function_rest()
        if self.at("operator"):
            return self.declarators(True)
        self.i = start
        self.type()
        if self.accept(";"):
            return None
        return self.declarators(True)

    def declarators(self, functions: bool) -> None:
        while True:
            self.declared_name()
            if self.at("(") and functions and self.attempt(self.parameters):
                return self.function_rest()
            if self.accept(":"):
                self.operand()
            self.initialiser()
            if not self.accept(","):
                break
        self.expect(";")

    def function_rest(self) -> None:
        while True:
            if self.accept("const", "noexcept", "override", "final", "&", "&&", "volatile", "mutable"):
                if self.at("(") and self.toks[self.i - 1] == "noexcept":
                    self.balanced()
            elif self.accept("throw"):
                self.balanced()
            elif self.accept("->"):
                self.type()
            elif self.accept("requires"):
                self.expression()
            else:
                break
        if self.accept("="):
            if not self.accept("default", "delete"):
                if self.toks[self.i] != "0":
                    raise Bad("function value")
                self.i += 1
            return self.expect(";")
        if self.accept(";"):
            return None
        if self.accept("try"):
            pass
        if self.accept(":"):
            while True:
                self.type()
                if not self.at("(", "{"):
                    raise Bad("member value")
                self.balanced()
                self.accept("...")
                if not self.accept(","):
                    break
        return self.block()

    def parameters(self) -> None:
        self.expect("(")
        if self.accept(")"):
            return
        while True:
            self.attributes()
            if self.accept("..."):
                break
            self.type()
            self.accept("...")
            if self.at("(") and self.toks[self.i + 1] in ("*", "&"):
                self.i += 2
                if self.is_name():
                    self.i += 1
                self.expect(")")
                self.parameters()
            elif self.is_name():
                self.i += 1
            while self.accept("["):
                if not self.at("]"):
                    self.expression()
                self.expect("]")
            if self.accept("="):
                self.value()
            if not self.accept(","):
                break
        self.expect(")")

    def type(self) -> None:
        self.attributes()
        named = False
        while self.at(*self.specifiers):
            if self.at("struct", "class", "enum", "union") and self.aggregate():
                named = True
                break
            self.i += 1
        if self.accept("decltype"):
            self.balanced()
            named = True
        while self.at(*self.basic):
            self.i += 1
            named = True
            while self.accept("const", "volatile"):
                pass
        if not named:
            self.accept("::")
            while True:
                self.accept("template")
                self.name()
                if self.at("<"):
                    self.template_arguments()
                if not (self.at("::") and self.kinds[self.i + 1] == "id" and self.toks[self.i + 1] != "operator"):
                    break
                self.i += 1
        while self.accept("const", "volatile", "*", "&", "&&"):
            pass

    def abstract(self) -> None:
        if self.at("(", "["):
            self.balanced()
            while self.at("(", "["):
                self.balanced()

    def template_arguments(self) -> None:
        self.expect("<")
        if self.at(">"):
            self.i += 1
            return
        while True:
            if not self.attempt(lambda: (self.type(), self.abstract(), self.accept("..."), self.at(",") or self.toks[self.i][:1] == ">" or self.fail())):
                self.operand()
                while self.kinds[self.i] == "op" and self.toks[self.i] in ("+", "-", "*", "/", "%", "==", "!=", "&&", "||"):
                    self.i += 1
                    self.operand()
            if not self.accept(","):
                break
        self.close_angle()

    def fail(self) -> None:
        raise Bad("no")

    def declared_name(self) -> None:
        while self.accept("*", "&", "&&", "const"):
            pass
        if self.accept("["):
            self.name()
            while self.accept(","):
                self.name()
            return self.expect("]")
        if self.at("(") and self.toks[self.i + 1] in ("*", "&"):
            self.i += 2
            self.name()
            self.expect(")")
            return self.parameters() if self.at("(") else None
        if self.accept("operator"):
            return self.operator_name()
        self.name()
        while True:
            if self.at("<"):
                if not self.attempt(self.template_arguments):
                    break
            if not self.accept("::"):
                break
            if self.accept("operator"):
                return self.operator_name()
            self.accept("~")
            self.name()
        return None

    def operator_name(self) -> None:
        if self.at("(", "["):
            self.balanced()
        elif self.at("new", "delete"):
            self.i += 1
            if self.at("["):
                self.balanced()
        elif self.kinds[self.i] == "op":
            self.i += 1
        else:
            self.type()

    def initialiser(self) -> None:
        while self.accept("["):
            if not self.at("]"):
                self.expression()
            self.expect("]")
        if self.accept("="):
            self.value()
        elif self.at("{"):
            self.value()
        elif self.accept("("):
            self.sequence(")", self.argument)

    def value(self) -> None:
        if self.accept("{"):
            self.sequence("}", self.field)
        else:
            self.expression()

    def field(self) -> None:
        if self.at(".") and self.kinds[self.i + 1] == "id":
            self.i += 2
            self.accept("=")
        self.value()

    def argument(self) -> None:
        self.value()
        self.accept("...")

    def condition(self) -> None:
        self.accept("constexpr")
        self.expect("(")
        if self.attempt(lambda: (self.declaration(), None)):
            pass
        if not self.attempt(lambda: (self.type(), self.declared_name(), self.at("=", "{") or self.fail(), self.initialiser(), self.expect(")"))):
            self.expressions()
            self.expect(")")

    def local_type(self) -> bool:
        if self.at("struct", "class", "enum", "union"):
            start = self.i
            if self.aggregate():
                if not self.accept(";"):
                    self.declarators(False)
                return True
            self.i = start
        return False

    def s_return(self) -> None:
        if not self.at(";"):
            self.value()
        self.expect(";")

    def s_for(self) -> None:
        self.expect("(")
        if self.attempt(self.each):
            self.expect(")")
            return self.statement()
        if not self.accept(";"):
            if not self.attempt(self.declaration):
                self.expressions()
                self.expect(";")
        if not self.at(";"):
            self.expressions()
        self.expect(";")
        if not self.at(")"):
            self.expressions()
        self.expect(")")
        return self.statement()

    def each(self) -> None:
        self.type()
        self.declared_name()
        self.expect(":")
        self.value()
        if not self.at(")"):
            raise Bad(") expected")

    def s_try(self) -> None:
        self.block()
        if not self.at("catch"):
            raise Bad("try without catch")
        while self.accept("catch"):
            self.expect("(")
            if not self.accept("..."):
                self.type()
                if self.is_name():
                    self.i += 1
            self.expect(")")
            self.block()

    def s_using(self) -> None:
        self.using()

    def s_goto(self) -> None:
        self.name()
        self.expect(";")

    def s_assert(self) -> None:
        self.balanced()
        self.expect(";")

    RULES = CLike.RULES | {"try": s_try, "using": s_using, "goto": s_goto, "return": s_return, "for": s_for, "static_assert": s_assert}

    def suffix(self) -> bool:
        t = self.toks[self.i]
        if t == "::":
            self.i += 1
            if self.accept("operator"):
                self.operator_name()
                return True
            self.accept("template", "~")
            super().member_name()
            return True
        if t == "<":
            return self.attempt(lambda: (self.template_arguments(), self.at("(", "::", "{", ")", ",", ";") or self.fail()))
        if t == "{":
            before = self.toks[self.i - 1]
            if self.kinds[self.i - 1] == "id" and before not in self.reserved or before == ">":
                self.value()
                return True
            return False
        if t == "[":
            self.i += 1
            self.value()
            self.expect("]")
            return True
        return super().suffix()

    def member_name(self) -> None:
        self.accept("template", "~", "*")
        if self.accept("operator"):
            return self.operator_name()
        return super().member_name()

    def operand(self) -> None:
        while self.kinds[self.i] in ("op", "id") and self.toks[self.i] in self.prefix:
            self.i += 1
            if self.toks[self.i - 1] == "throw" and self.at(";", ":", ")"):
                return
        self.primary()
        self.suffixes()

    def primary(self) -> None:
        k, t = self.kinds[self.i], self.toks[self.i]
        if k == "str":
            while self.kinds[self.i] == "str":
                self.i += 1
            if self.is_name() and self.toks[self.i] in ("s", "sv"):
                self.i += 1
            return None
        if k == "id":
            if t in ("static_cast", "dynamic_cast", "const_cast", "reinterpret_cast"):
                self.i += 1
                self.template_arguments()
                if not self.at("("):
                    raise Bad("cast")
                return self.balanced()
            if t in ("sizeof", "typeid", "noexcept", "alignof", "decltype"):
                self.i += 1
                self.accept("...")
                if self.at("("):
                    return self.balanced()
                return self.operand()
            if t == "new":
                self.i += 1
                if self.at("("):
                    self.balanced()
                self.type()
                while self.accept("["):
                    self.expression()
                    self.expect("]")
                if self.accept("("):
                    self.sequence(")", self.argument)
                elif self.at("{"):
                    self.value()
                return None
            if t == "delete":
                self.i += 1
                if self.accept("["):
                    self.expect("]")
                return self.operand()
            if t in self.basic or t == "typename":
                self.type()
                if self.at("("):
                    return None
                if self.at("{"):
                    return self.value()
                raise Bad("type as operand")
            if t == "operator":
                self.i += 1
                return self.operator_name()
        elif k == "op":
            if t == "(":
                if self.attempt(self.cast):
                    return None
                if self.attempt(lambda: (self.expect("("), self.accept("..."), self.expressions(), self.expect(")"))):
                    return None
                if self.toks[self.i + 1] == "{" or "..." in self.toks:
                    return self.balanced()
                if not self.whole:
                    raise IndexError
                raise Bad("in parentheses")
            if t == "[":
                self.balanced()
                if self.at("<"):
                    self.template_parameters()
                if self.at("("):
                    self.parameters()
                while self.accept("mutable", "constexpr", "noexcept"):
                    pass
                if self.accept("->"):
                    self.type()
                return self.block()
            if t == "::":
                self.i += 1
                return self.name() and None
        return super().primary()

    def cast(self) -> None:
        self.expect("(")
        self.type()
        self.abstract()
        sure = self.toks[self.i - 1] in self.basic or self.toks[self.i - 1] in ("*", "&", ">")
        self.expect(")")
        follows = self.kinds[self.i] in ("id", "num", "str") or self.at("(", "!", "~") or (sure and self.at("-", "+", "*", "&", "++", "--", "{"))
        if not follows or (self.kinds[self.i] == "id" and self.toks[self.i] in self.reserved and self.toks[self.i] not in self.values | _words("sizeof new static_cast")):
            raise Bad("not a cast")
        if self.at("{"):
            return self.value()
        return self.operand()


class Go(Parser):
    lexer = _lexer(
        r"//[^\n]*|/\*.*?\*/",
        rf"`[^`]*`|{_DQ}|'(?:[^'\\\n]|\\.[^'\n]*)'",
        "{ } ( ) [ ] ; , . ... : := = == != < <= > >= + - * / % & | ^ << >> &^ += -= *= /= %= &= |= ^= <<= >>= &^= && || <- ++ -- ! ~",
        r"[^\W\d]\w*",
    )
    prefix = _words("+ - ! ^ * & <- ~")
    postfix = frozenset()
    binary = _words("|| && == != < <= > >= + - | ^ * / % << >> & &^")
    reserved = _words("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var")
    assign = _words("= := += -= *= /= %= &= |= ^= <<= >>= &^=")

    def lex(self, text: str) -> None:
        super().lex(text)
        # a line end after an operand, a jump or a closing token is a semicolon
        kinds, toks = [], []
        for k, t, fresh in zip(self.kinds, self.toks, self.line):
            if fresh and kinds:
                self._semicolon(kinds, toks)
            kinds.append(k)
            toks.append(t)
        self._semicolon(kinds, toks)
        self.kinds, self.toks, self.line = kinds, toks, [False] * len(kinds)
        self.literals = True

    def _semicolon(self, kinds: list, toks: list) -> None:
        if kinds and (kinds[-1] in ("num", "str") or (kinds[-1] == "id" and (toks[-1] not in self.reserved or toks[-1] in ("break", "continue", "fallthrough", "return"))) or (kinds[-1] == "op" and toks[-1] in ("++", "--", ")", "]", "}"))):
            kinds.append("op")
            toks.append(";")

    def end(self, *closers: str) -> None:
        if not self.accept(";") and not self.at(*closers, "}", ")") and self.kinds[self.i] != "eof":
            raise Bad(f"end of statement expected, found {self.toks[self.i]!r}")

    def program(self) -> None:
        self.expect("package")
        self.name()
        self.expect(";")
        while self.accept("import"):
            self.grouped(self.spec_import)
        while self.kinds[self.i] != "eof":
            if self.at("func"):
                self.i += 1
                if self.at("("):
                    self.parameters()
                self.name()
                if self.at("["):
                    self.balanced()
                self.signature()
                if self.at("{"):
                    self.block()
                self.end()
            else:
                self.declaration()

    def grouped(self, item) -> None:
        if self.accept("("):
            while not self.accept(")"):
                item()
                if not self.accept(";"):
                    self.expect(")")
                    break
        else:
            item()
        self.end()

    def spec_import(self) -> None:
        if self.is_name() or self.at("."):
            self.i += 1
        if self.kinds[self.i] != "str":
            raise Bad("import path")
        self.i += 1

    def declaration(self) -> None:
        if self.accept("var", "const"):
            self.grouped(self.spec_value)
        elif self.accept("type"):
            self.grouped(self.spec_type)
        else:
            raise Bad(f"declaration expected, found {self.toks[self.i]!r}")

    def spec_value(self) -> None:
        self.name()
        while self.accept(","):
            self.name()
        if not self.at("=", ";", ")"):
            self.type()
        if self.accept("="):
            self.expressions()

    def spec_type(self) -> None:
        self.name()
        if self.at("[") and self.kinds[self.i + 1] == "id" and self.toks[self.i + 2] != "]":
            self.balanced()
        self.accept("=")
        self.type()

    def type(self) -> None:
        t = self.toks[self.i]
        if t == "(":
            self.i += 1
            self.type()
            self.expect(")")
        elif t == "*":
            self.i += 1
            self.type()
        elif t == "[":
            self.i += 1
            if not self.accept("]"):
                if not self.accept("..."):
                    self.expression()
                self.expect("]")
            self.type()
        elif t == "map":
            self.i += 1
            self.expect("[")
            self.type()
            self.expect("]")
            self.type()
        elif t in ("chan", "<-"):
            self.accept("<-")
            self.expect("chan")
            self.accept("<-")
            self.type()
        elif t == "func":
            self.i += 1
            self.signature()
        elif t in ("struct", "interface"):
            self.i += 1
            if not self.at("{"):
                raise Bad("{ expected")
            self.balanced()
        else:
            self.name()
            if self.accept("."):
                self.name()
            if self.at("[") and self.toks[self.i + 1] != "]":
                self.attempt(self.type_arguments)

    def type_arguments(self) -> None:
        self.expect("[")
        self.type()
        while self.accept(","):
            self.type()
        self.expect("]")

    def parameters(self) -> None:
        self.expect("(")
        if self.accept(")"):
            return
        while True:
            if not self.attempt(lambda: (self.name(), self.accept("..."), self.type())):
                self.accept("...")
                self.type()
            if not self.accept(","):
                break
            if self.at(")"):
                break
        self.expect(")")

    def signature(self) -> None:
        self.parameters()
        if self.at("("):
            self.parameters()
        elif not self.at("{", ";", ")", ",", "}", "]", "=", ":=", ":") and self.kinds[self.i] in ("id", "op"):
            if self.kinds[self.i] == "id" or self.at("*", "[", "<-"):
                self.type()

    def block(self) -> None:
        self.expect("{")
        outer, self.literals = self.literals, True
        while not self.accept("}"):
            if self.kinds[self.i] == "eof":
                raise Bad("block not closed")
            self.statement()
        self.literals = outer

    def expressions(self) -> None:
        self.expression()
        while self.accept(","):
            self.expression()

    def simple(self, ranged: bool = False) -> None:
        if ranged and self.accept("range"):
            return self.expression()
        self.expressions()
        if self.accept(*self.assign):
            if ranged and self.accept("range"):
                return self.expression()
            return self.expressions()
        if self.accept("++", "--"):
            return None
        if self.accept("<-"):
            return self.expression()
        return None

    def header(self, ranged: bool) -> int:
        """What stands between the keyword and the block: up to three parts; no bare composite literals. Returns the semicolons."""
        outer, self.literals = self.literals, False
        parts = 0
        while not self.at("{"):
            if self.accept(";"):
                parts += 1
                if parts > 2:
                    raise Bad("too many parts")
            else:
                self.simple(ranged)
                if not self.at("{", ";"):
                    raise Bad(f"block expected, found {self.toks[self.i]!r}")
        self.literals = outer
        return parts

    def statement(self) -> None:
        k, t = self.kinds[self.i], self.toks[self.i]
        if t == ";" and k == "op":
            self.i += 1
            return None
        if t == "{" and k == "op":
            self.block()
            return self.end()
        if k == "id" and t in self.reserved:
            if t in ("var", "const", "type"):
                return self.declaration()
            self.i += 1
            if t == "if":
                return self.s_if()
            if t == "for":
                if self.header(True) == 1:
                    raise Bad("for with one semicolon")
                self.block()
                return self.end()
            if t in ("switch", "select"):
                self.header(False)
                return self.s_switch()
            if t == "return":
                if not self.at(";", "}"):
                    self.expressions()
                return self.end()
            if t in ("break", "continue", "goto"):
                if self.is_name():
                    self.i += 1
                return self.end()
            if t == "fallthrough":
                return self.end()
            if t in ("go", "defer"):
                self.expression()
                return self.end()
            self.i -= 1
        if self.is_name() and self.toks[self.i + 1] == ":" and self.kinds[self.i + 1] == "op":
            self.i += 2
            return None
        self.simple()
        return self.end()

    def s_if(self) -> None:
        if self.at("{"):
            raise Bad("condition expected")
        self.header(False)
        if self.toks[self.i - 1] == ";":
            raise Bad("condition expected")
        self.block()
        if self.accept("else"):
            if self.accept("if"):
                return self.s_if()
            self.block()
        return self.end()

    def s_switch(self) -> None:
        self.expect("{")
        outer, self.literals = self.literals, True
        while not self.accept("}"):
            if self.accept("case"):
                while True:
                    if not self.attempt(lambda: (self.simple(), self.at(",", ":") or self.fail())):
                        self.type()
                    if not self.accept(","):
                        break
            else:
                self.expect("default")
            self.expect(":")
            while not self.at("case", "default", "}"):
                if self.kinds[self.i] == "eof":
                    raise Bad("switch not closed")
                self.statement()
        self.literals = outer
        self.end()

    def fail(self) -> None:
        raise Bad("no")

    def suffix(self) -> bool:
        t = self.toks[self.i]
        if t == "(":
            self.i += 1
            outer, self.literals = self.literals, True
            self.sequence(")", self.argument)
            self.literals = outer
            return True
        if t == "[":
            self.i += 1
            while not self.accept("]"):
                if not self.accept(":", ","):
                    if not self.attempt(self.expression):
                        self.type()
            return True
        if t == ".":
            self.i += 1
            if self.accept("("):
                if not self.accept("type"):
                    self.type()
                self.expect(")")
            else:
                self.name()
            return True
        if t == "{" and self.literals and (self.kinds[self.i - 1] == "id" or self.toks[self.i - 1] == "]"):
            self.elements()
            return True
        return False

    def elements(self) -> None:
        self.expect("{")
        outer, self.literals = self.literals, True

        def one() -> None:
            self.elements() if self.at("{") else self.expression()
            if self.accept(":"):
                self.elements() if self.at("{") else self.expression()

        self.sequence("}", one)
        self.literals = outer

    def argument(self) -> None:
        if not self.attempt(lambda: (self.expression(), self.at(",", ")", "...") or self.fail())):
            self.type()
        self.accept("...")

    def primary(self) -> None:
        t, k = self.toks[self.i], self.kinds[self.i]
        if k == "op" and t == "(":
            self.i += 1
            outer, self.literals = self.literals, True
            if not self.attempt(lambda: (self.expression(), self.expect(")"))):
                self.type()
                self.expect(")")
            self.literals = outer
            return None
        if k == "id" and t == "func":
            self.i += 1
            self.signature()
            if not self.at("{"):
                return None
            return self.block()
        if (k == "op" and t == "[") or (k == "id" and t in ("map", "struct", "chan", "interface")):
            self.type()
            if self.at("{"):
                return self.elements()
            if self.at("("):
                return None
            if self.at(",", ")"):
                return None
            raise Bad("type as operand")
        return super().primary()


class Rust(Parser):
    lexer = _lexer(
        r"//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*\*/",
        r'b?r(?P<h>#{0,6})".*?"(?P=h)|b?"(?:[^"\\]|\\.)*"|b?\'(?:[^\'\\\n]|\\[^\n\']+|\\\')\'',
        "{ } ( ) [ ] ; , . .. ... ..= : :: -> => = == != < <= > >= + - * / % ^ ! & | && || << >> += -= *= /= %= ^= &= |= <<= >>= @ # $ ? ~",
        r"r#[^\W\d]\w*|'[^\W\d]\w*(?!')|[^\W\d]\w*",
    )
    prefix = _words("- ! * & && mut")
    postfix = frozenset(("?",))
    binary = Parser.binary
    reserved = _words(
        "as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await dyn"
    )
    values = _words("self Self true false crate super")

    def program(self) -> None:
        while self.at("#") and self.toks[self.i + 1] == "!":
            self.i += 2
            self.balanced()
        while self.kinds[self.i] != "eof":
            self.item()

    def attributes(self) -> None:
        while self.at("#"):
            self.i += 1
            self.accept("!")
            if not self.at("["):
                raise Bad("attribute")
            self.balanced()

    def visibility(self) -> None:
        if self.accept("pub") and self.at("(") and self.toks[self.i + 1] in ("crate", "super", "self", "in"):
            self.balanced()

    ITEMS = _words("fn struct enum impl trait mod use const static type extern unsafe async pub union macro_rules")

    def is_item(self) -> bool:
        t = self.toks[self.i]
        if self.kinds[self.i] != "id" or t not in self.ITEMS:
            return False
        n = self.toks[self.i + 1]
        if t == "unsafe":
            return n in ("fn", "impl", "trait", "extern")
        if t == "async":
            return n == "fn"
        if t == "macro_rules":
            return n == "!"
        if t == "union":
            return self.kinds[self.i + 1] == "id"
        return True

    def item(self) -> None:
        self.attributes()
        if self.kinds[self.i] == "eof":
            raise Bad("item expected")
        if self.at("macro_rules"):
            self.i += 1
            self.expect("!")
            self.name()
            return self.balanced()
        self.visibility()
        while self.at("unsafe", "async", "default") or (self.at("const") and self.toks[self.i + 1] in ("fn", "unsafe", "async")) or (self.at("extern") and self.kinds[self.i + 1] == "str" and self.toks[self.i + 2] == "fn"):
            self.i += 1
            if self.kinds[self.i] == "str":
                self.i += 1
        if self.accept("fn"):
            return self.function()
        if self.accept("struct", "union"):
            self.name()
            self.generics()
            self.where()
            if self.at("("):
                self.i += 1

                def one() -> None:
                    self.attributes()
                    self.visibility()
                    self.type()

                self.sequence(")", one)
                self.where()
                return self.expect(";")
            if self.accept("{"):
                return self.sequence("}", self.field)
            return self.expect(";")
        if self.accept("enum"):
            self.name()
            self.generics()
            self.where()
            self.expect("{")

            def variant() -> None:
                self.attributes()
                self.name()
                if self.at("("):
                    self.balanced()
                elif self.accept("{"):
                    self.sequence("}", self.field)
                if self.accept("="):
                    self.expression()

            return self.sequence("}", variant)
        if self.accept("impl"):
            self.generics()
            self.accept("!")
            self.type()
            if self.accept("for"):
                self.type()
            self.where()
            return self.items()
        if self.accept("trait"):
            self.name()
            self.generics()
            if self.accept(":"):
                self.bounds()
            self.where()
            return self.items()
        if self.accept("mod"):
            self.name()
            return None if self.accept(";") else self.items()
        if self.accept("use"):
            self.use_tree()
            return self.expect(";")
        if self.accept("const", "static"):
            self.accept("mut")
            if not self.accept("_"):
                self.name()
            self.expect(":")
            self.type()
            if self.accept("="):
                self.expression()
            return self.expect(";")
        if self.accept("type"):
            self.name()
            self.generics()
            if self.accept(":"):
                self.bounds()
            if self.accept("="):
                self.type()
            self.where()
            return self.expect(";")
        if self.accept("extern"):
            if self.accept("crate"):
                self.name()
                if self.accept("as"):
                    self.name()
                return self.expect(";")
            if self.kinds[self.i] == "str":
                self.i += 1
            return self.items()
        if self.is_name() and self.toks[self.i + 1] == "!":
            return self.macro_statement()
        raise Bad(f"item expected, found {self.toks[self.i]!r}")

    def items(self) -> None:
        self.expect("{")
        while not self.accept("}"):
            self.item()

    def field(self) -> None:
        self.attributes()
        self.visibility()
        self.name()
        self.expect(":")
        self.type()

    def use_tree(self) -> None:
        self.accept("::")
        while True:
            if self.accept("*"):
                return
            if self.accept("{"):
                return self.sequence("}", self.use_tree)
            if self.kinds[self.i] != "id":
                raise Bad("path expected")
            self.i += 1
            if self.accept("as"):
                self.i += 1
                return
            if not self.accept("::"):
                return

    def generics(self) -> None:
        if not self.accept("<"):
            return
        while not self.at(">"):
            self.attributes()
            self.accept("const")
            if self.kinds[self.i] != "id":
                raise Bad("parameter expected")
            self.i += 1
            if self.accept(":"):
                self.bounds()
            if self.accept("="):
                self.type()
            if not self.accept(","):
                break
        self.close_angle()

    def bounds(self) -> None:
        while self.kinds[self.i] == "id" or self.at("?", "("):
            self.accept("?")
            self.type()
            if not self.accept("+"):
                return

    def where(self) -> None:
        if self.accept("where"):
            while not self.at("{", ";"):
                self.type()
                self.expect(":")
                self.bounds()
                if not self.accept(","):
                    break

    def function(self) -> None:
        self.name()
        self.generics()
        self.expect("(")

        def one() -> None:
            self.attributes()
            start = self.i
            self.accept("&")
            if self.kinds[self.i] == "id" and self.toks[self.i][0] == "'":
                self.i += 1
            self.accept("mut")
            if self.accept("self"):
                if self.accept(":"):
                    self.type()
                return
            self.i = start
            self.pattern()
            self.expect(":")
            self.type()

        self.sequence(")", one)
        if self.accept("->"):
            self.type()
        self.where()
        if not self.accept(";"):
            self.block()

    def type(self) -> None:
        if self.accept("&", "&&"):
            if self.kinds[self.i] == "id" and self.toks[self.i][0] == "'":
                self.i += 1
            self.accept("mut")
            return self.type()
        if self.accept("*"):
            if not self.accept("const", "mut"):
                raise Bad("pointer")
            return self.type()
        if self.accept("["):
            self.type()
            if self.accept(";"):
                self.expression()
            return self.expect("]")
        if self.accept("("):
            return self.sequence(")", self.type)
        if self.accept("!", "_"):
            return None
        if self.accept("dyn", "impl"):
            return self.bounds()
        if self.accept("for"):
            self.generics()
            return self.type()
        while self.at("unsafe", "extern") or (self.kinds[self.i] == "str" and self.toks[self.i + 1] == "fn"):
            self.i += 1
        if self.accept("fn"):
            if not self.at("("):
                raise Bad("fn type")
            self.balanced()
            if self.accept("->"):
                self.type()
            return None
        if self.accept("<"):
            self.type()
            if self.accept("as"):
                self.type()
            self.close_angle()
            self.expect("::")
        self.accept("::")
        while True:
            if self.kinds[self.i] != "id" or (self.toks[self.i] in self.reserved and self.toks[self.i] not in self.values):
                raise Bad(f"type expected, found {self.toks[self.i]!r}")
            self.i += 1
            if self.at("<") or (self.at("::") and self.toks[self.i + 1] == "<"):
                self.accept("::")
                self.arguments()
            elif self.at("(") and self.toks[self.i - 1] in ("Fn", "FnMut", "FnOnce"):
                self.balanced()
                if self.accept("->"):
                    self.type()
            if not (self.at("::") and self.kinds[self.i + 1] == "id"):
                return None
            self.i += 1

    def arguments(self) -> None:
        self.expect("<")
        while self.toks[self.i][:1] != ">":
            if self.kinds[self.i] == "num":
                self.i += 1
            elif self.at("{"):
                self.balanced()
            elif self.is_name() and self.toks[self.i + 1] in ("=", ":"):
                self.i += 2
                self.type()
            else:
                self.type()
            if not self.accept(","):
                break
        self.close_angle()

    def pattern(self) -> None:
        self.accept("|")
        while True:
            self.one_pattern()
            if not self.accept("|"):
                return

    def one_pattern(self) -> None:
        if self.accept("_", ".."):
            return
        if self.accept("&", "&&"):
            return self.one_pattern()
        if self.accept("("):
            return self.sequence(")", self.pattern)
        if self.accept("["):
            return self.sequence("]", self.pattern)
        while self.accept("ref", "mut", "box"):
            pass
        self.accept("-")
        if self.kinds[self.i] in ("num", "str"):
            self.i += 1
        elif self.kinds[self.i] == "id" and (self.toks[self.i] not in self.reserved or self.toks[self.i] in self.values):
            self.i += 1
            while self.accept("::"):
                if self.at("<"):
                    self.arguments()
                else:
                    self.i += 1
            if self.at("!"):
                self.i += 1
                return self.balanced()
            if self.accept("("):
                return self.sequence(")", self.pattern)
            if self.accept("{"):

                def one() -> None:
                    self.attributes()
                    if self.accept(".."):
                        return
                    while self.accept("ref", "mut"):
                        pass
                    self.name()
                    if self.accept(":"):
                        self.pattern()

                return self.sequence("}", one)
            if self.accept("@"):
                return self.one_pattern()
        else:
            raise Bad(f"pattern expected, found {self.toks[self.i]!r}")
        if self.accept("..=", "..", "..."):
            self.accept("-")
            if self.kinds[self.i] in ("num", "str", "id") and not self.at("if"):
                self.i += 1
        return None

    def block(self) -> None:
        self.expect("{")
        outer, self.no_struct = getattr(self, "no_struct", False), False
        while not self.accept("}"):
            if self.kinds[self.i] == "eof":
                raise Bad("block not closed")
            self.statement()
        self.no_struct = outer

    BLOCKLIKE = _words("if while loop for match unsafe")

    def macro_statement(self) -> None:
        self.i += 1
        while self.accept("::"):
            self.name()
        self.expect("!")
        if not self.at("(", "[", "{"):
            raise Bad("macro")
        braces = self.at("{")
        self.balanced()
        if not braces:
            self.expect(";")

    def statement(self) -> None:
        if self.accept(";"):
            return None
        self.attributes()
        if self.is_item():
            return self.item()
        t, k = self.toks[self.i], self.kinds[self.i]
        if k == "id" and t == "let":
            self.i += 1
            self.pattern()
            if self.accept(":"):
                self.type()
            if self.accept("="):
                self.expression()
                if self.accept("else"):
                    self.block()
            return self.expect(";")
        start = self.i
        label = k == "id" and t[0] == "'"
        if (k == "id" and (t in self.BLOCKLIKE or label)) or (k == "op" and t == "{"):
            self.primary()
            if self.at(".", "?"):
                self.suffixes()
                self.tail()
            elif self.accept(";") or self.at("}"):
                return None
            else:
                return None
        else:
            self.expression()
        if self.accept(";") or self.at("}"):
            return None
        if self.toks[self.i - 1] == "}" and "!" in self.toks[start + 1 : start + 4]:
            return None
        raise Bad(f"; expected, found {self.toks[self.i]!r}")

    def tail(self) -> None:
        while self.kinds[self.i] in ("op", "id") and self.toks[self.i] in self.binary:
            self.i += 1
            self.operand()
        self.more()

    def more(self) -> bool:
        if self.accept("as"):
            self.type()
            return True
        if self.at("..", "..="):
            self.i += 1
            if self.starts_operand():
                self.operand()
            return True
        return False

    def starts_operand(self) -> bool:
        k, t = self.kinds[self.i], self.toks[self.i]
        if k in ("num", "str"):
            return True
        if k == "id":
            return t not in self.reserved or t in self.values or t in ("if", "match", "move", "unsafe")
        if t == "{" and getattr(self, "no_struct", False):
            return False
        return t in ("(", "[", "-", "!", "*", "&", "|", "||")

    def operand(self) -> None:
        if self.at("..", "..="):
            return
        super().operand()

    def suffix(self) -> bool:
        t = self.toks[self.i]
        if t == ".":
            self.i += 1
            if self.kinds[self.i] == "num" or self.accept("await"):
                self.i += self.kinds[self.i] == "num"
                return True
            if self.kinds[self.i] != "id":
                raise Bad("member expected")
            self.i += 1
            if self.at("::"):
                self.i += 1
                self.arguments()
            return True
        if t == "(":
            self.i += 1
            outer, self.no_struct = getattr(self, "no_struct", False), False
            self.sequence(")", self.argument)
            self.no_struct = outer
            return True
        if t == "[":
            self.i += 1
            outer, self.no_struct = getattr(self, "no_struct", False), False
            self.expression()
            self.expect("]")
            self.no_struct = outer
            return True
        return super().suffix()

    def header(self) -> None:
        outer, self.no_struct = getattr(self, "no_struct", False), True
        while True:
            if self.accept("let"):
                self.pattern()
                self.expect("=")
                self.expression()
            else:
                self.expression()
            if not self.accept("&&"):
                break
        self.no_struct = outer

    def expression(self) -> None:
        if self.at("let"):
            self.i += 1
            self.pattern()
            self.expect("=")
        super().expression()

    def primary(self) -> None:
        k, t = self.kinds[self.i], self.toks[self.i]
        if k == "id":
            if t[0] == "'":
                self.i += 1
                self.expect(":")
                return self.primary()
            if t == "if":
                self.i += 1
                self.header()
                self.block()
                if self.accept("else"):
                    if self.at("if"):
                        return self.primary()
                    self.block()
                return None
            if t == "while":
                self.i += 1
                self.header()
                return self.block()
            if t in ("loop", "unsafe", "async", "const") and (t != "async" or self.toks[self.i + 1] in ("{", "move")):
                self.i += 1
                self.accept("move")
                return self.block()
            if t == "for":
                self.i += 1
                self.pattern()
                self.expect("in")
                self.header()
                return self.block()
            if t == "match":
                self.i += 1
                self.header()
                return self.arms()
            if t in ("return", "break"):
                self.i += 1
                if self.kinds[self.i] == "id" and self.toks[self.i][0] == "'":
                    self.i += 1
                if self.starts_operand() or (self.at("{") and not getattr(self, "no_struct", False)):
                    self.expression()
                return None
            if t == "continue":
                self.i += 1
                if self.kinds[self.i] == "id" and self.toks[self.i][0] == "'":
                    self.i += 1
                return None
            if t == "move":
                self.i += 1
                return self.closure()
            if t not in self.reserved or t in self.values:
                return self.path()
        elif k == "op":
            if t in ("|", "||"):
                return self.closure()
            if t == "(":
                self.i += 1
                outer, self.no_struct = getattr(self, "no_struct", False), False
                self.sequence(")", self.expression)
                self.no_struct = outer
                return None
            if t == "[":
                self.i += 1
                outer, self.no_struct = getattr(self, "no_struct", False), False
                if not self.accept("]"):
                    self.expression()
                    if self.accept(";"):
                        self.expression()
                        self.expect("]")
                    elif self.accept(","):
                        self.sequence("]", self.expression)
                    else:
                        self.expect("]")
                self.no_struct = outer
                return None
            if t == "{":
                return self.block()
            if t == "<":
                self.type()
                return None
            if t == "::":
                self.i += 1
                return self.path()
        return super().primary()

    def path(self) -> None:
        self.i += 1
        while self.at("::"):
            self.i += 1
            if self.at("<"):
                self.arguments()
            elif self.kinds[self.i] == "id":
                self.i += 1
            else:
                raise Bad("path")
        if self.at("!") and self.toks[self.i + 1] in ("(", "[", "{"):
            self.i += 1
            return self.balanced()
        if self.at("{") and not getattr(self, "no_struct", False) and (self.toks[self.i + 1] in ("}", "..") or (self.kinds[self.i + 1] == "id" and self.toks[self.i + 2] in (":", ",", "}"))):
            self.i += 1

            def one() -> None:
                if self.accept(".."):
                    return self.expression()
                self.attributes()
                if self.kinds[self.i] not in ("id", "num"):
                    raise Bad("field")
                self.i += 1
                if self.accept(":"):
                    self.expression()
                return None

            self.sequence("}", one)
        return None

    def closure(self) -> None:
        if not self.accept("||"):
            self.expect("|")
            while not self.accept("|"):
                self.one_pattern()
                if self.accept(":"):
                    self.type()
                if not self.accept(","):
                    self.expect("|")
                    break
        if self.accept("->"):
            self.type()
            return self.block()
        self.expression()
        return None

    def arms(self) -> None:
        self.expect("{")
        outer, self.no_struct = getattr(self, "no_struct", False), False
        while not self.accept("}"):
            self.attributes()
            self.pattern()
            if self.accept("if"):
                self.expression()
            self.expect("=>")
            braces = self.at("{")
            self.expression()
            if not self.accept(",") and not self.at("}") and not braces:
                raise Bad(", expected")
        self.no_struct = outer


def _python(text: str) -> bool:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            compile(text, "text", "exec", dont_inherit=True)
            return True
        except (SyntaxError, ValueError):
            return False
        except (RecursionError, MemoryError):
            try:
                return _matched([t.string for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type == tokenize.OP])
            except (SyntaxError, tokenize.TokenError):
                return False


def _matched(toks: list[str]) -> bool:
    """Whether all round, square and curly delimiters are closed in turn."""
    closing, stack = {"(": ")", "[": "]", "{": "}"}, []
    for t in toks:
        if t in closing:
            stack.append(closing[t])
        elif t in (")", "]", "}") and (not stack or stack.pop() != t):
            return False
    return not stack


GRAMMARS = {"python": None, "javascript": JavaScript, "java": Java, "cpp": Cpp, "go": Go, "rust": Rust}
OUTSETS = (5, 20)
#: Fixed spellings of the languages' names.
ALIASES = {"py": "python", "python3": "python", "js": "javascript", "ecmascript": "javascript", "c++": "cpp", "cxx": "cpp", "cc": "cpp", "golang": "go", "rs": "rust"}


def parses(text: str, lang: str, likely: bool = False) -> bool:
    """Whether the text is valid syntax of the language; an unknown language raises KeyError.

    Unless it is likely to be, its first tokens are tried alone: what fails among them, without a look beyond, fails as a whole.
    """
    kind = GRAMMARS[lang]
    if kind is None:
        return _python(text)
    usual = sys.getrecursionlimit()
    try:
        for most in () if likely else OUTSETS:
            try:
                kind(text, most).run()
            except (IndexError, RecursionError):
                pass  # undecided
        parser = kind(text)
        if not _matched([t if k == "op" else "" for k, t in zip(parser.kinds, parser.toks)]):
            return False
        # frames of Python functions lie on the heap, so the descent may be as deep as the text
        sys.setrecursionlimit(max(usual, 5_000 + 60 * len(parser.toks)))
        parser.run()
        return True
    except (Bad, IndexError):
        return False
    finally:
        sys.setrecursionlimit(usual)


#: Fixed words and marks of each language, for the ranking.
TOKENS = {
    "python": "def elif None self from import in is lambda pass and or not True False print range yield with as except raise assert del nonlocal async await len __name__ __init__ ** : #".split(),
    "javascript": "function let const var === !== => console typeof undefined null new this async await export require module of catch throw delete ; { } ${ //".split(),
    "java": "public private protected static void class new String System extends implements throws final import package int boolean long null this @Override List ArrayList ; { } //".split(),
    "cpp": "#include std :: cout endl template typename namespace using int const auto long -> void nullptr << >> struct size_t vector main delete ; { } & //".split(),
    "go": "package func := fmt range chan defer go map import nil type struct interface var int string error <- make append { } //".split(),
    "rust": "fn let mut pub impl -> :: match use println struct enum trait i32 i64 u8 usize str Vec Some None Ok Err self & => ' ; { } //".split(),
}
_COMMON_TOKEN = re.compile(r"[@#]?[^\W\d]\w*|===|!==|\*\*|[:=<-]=|[=-]>|<-|::|<<|>>|//|\$\{|[{};:&'#]")
_WEIGHT = {t: 1 / sum(t in own for own in TOKENS.values()) for own in TOKENS.values() for t in own}
_SETS = {lang: frozenset(own) for lang, own in TOKENS.items()}


def rank_languages(text: str) -> list[tuple[str, float]]:
    """All languages with their scores, the best first: the different tokens of the text that are the language's, a token of n languages counting 1 / n.

    Ties are broken by the fixed order above.
    """
    there = set(_COMMON_TOKEN.findall(text))
    score = {lang: sum(_WEIGHT[t] for t in there & own) for lang, own in _SETS.items()}
    return sorted(score.items(), key=lambda x: -x[1])
