"""Per-file helper: JavaScript/TypeScript text to an IR module (a dict).

Covers the statement and expression forms the IR knows; anything else becomes
an opaque operand that only remembers its identifiers. It runs inside Spark
tasks, one file at a time; everything after it is a DataFrame operation.
"""

from __future__ import annotations

import hashlib
import re

from flowtide.functions.constants import NODE_PREFIX

TOKEN = re.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*.*?\*/)"
    r"|(?P<str>'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\")"
    r"|(?P<tpl>`(?:\\.|\$\{(?:[^{}]|\{[^{}]*\})*\}|[^`\\])*`)"
    r"|(?P<num>\d[\w.]*)"
    r"|(?P<name>[A-Za-z_$#][\w$]*)"
    r"|(?P<op>>>>=|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|\.\.\.|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\."
    r"|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|.)",
    re.S,
)
REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
BINARY = {
    op: level
    for level, ops in enumerate(
        ["?? ||", "&&", "|", "^", "&", "== != === !==", "< > <= >= instanceof in", "<< >> >>>", "+ -", "* / %", "**"]
    )
    for op in ops.split()
}
UNARY = {"!", "-", "+", "~", "typeof", "void", "delete"}
ASSIGN = {"+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
WORDS = set(
    "var let const function class return if else for while do switch case default break continue throw try catch"
    " finally new typeof void delete in of instanceof this super null true false async await import export from"
    " extends static get set yield as interface type enum".split()
)


def make_id(kind: str, signature: str, file_path: str = "", scope: str = "") -> str:
    digest = hashlib.md5(f"{file_path}::{scope}::{signature}".encode()).hexdigest()
    return f"{NODE_PREFIX[kind]}_{digest[:7]}"


def var(name):
    return {"type": "IRVar", "id": make_id("IRVar", name), "name": name}


def literal(value, value_type):
    return {"type": "IRLiteral", "id": make_id("IRLiteral", str(value)), "value": value, "value_type": value_type}


def access(root, path):
    return {"type": "IRAccess", "id": make_id("IRAccess", ".".join(path)), "root": root, "path": path}


def call_expr(target, args, receiver=None):
    made = {"type": "IRCallExpr", "id": make_id("IRCallExpr", target), "target": target, "args": args}
    return {**made, "receiver": receiver} if receiver else made


def known(node):
    return node is not None and node["type"] is not None


class FileReader:
    """Recursive descent over the tokens of one file."""

    def __init__(self, text: str, file_path: str):
        self.text, self.file_path = text, file_path
        self.functions, self.tok, self.i = [], [], 0
        self._tokenize()

    def _tokenize(self):
        pos, line, stack, text = 0, 1, [], self.text
        self.match = {}
        while pos < len(text):
            m, kind = TOKEN.match(text, pos), None
            if text[pos] == "/" and m.lastgroup == "op":
                last = self.tok[-1] if self.tok else ("op", "(")
                operand = last[0] in ("num", "str", "tpl") or last[1] in (")", "]", "}")
                operand = operand or (last[0] == "name" and last[1] not in ("return", "typeof", "case"))
                found = None if operand else REGEX.match(text, pos)
                m, kind = (found, "re") if found else (m, None)
            kind, value = kind or m.lastgroup, m.group()
            if kind != "skip":
                at = len(self.tok)
                if value in ("(", "[", "{") and kind == "op":
                    stack.append(at)
                elif value in (")", "]", "}") and kind == "op" and stack:
                    self.match[stack.pop()] = at
                self.tok.append((kind, value, line, pos, m.end()))
            line += value.count("\n")
            pos = m.end()
        for at in stack:
            self.match[at] = len(self.tok)

    # token access
    def peek(self, k=0):
        j = self.i + k
        return self.tok[j] if j < len(self.tok) else ("end", "", 0, len(self.text), len(self.text))

    def at(self, *values):
        return self.peek()[0] in ("op", "name") and self.peek()[1] in values

    def take(self, *values):
        if values and not self.at(*values):
            return False
        self.i += 1
        return True

    def source(self, first, last):
        """Text of the tokens first..last-1."""
        if last <= first or first >= len(self.tok):
            return ""
        return self.text[self.tok[first][3] : self.tok[min(last, len(self.tok)) - 1][4]]

    def names_in(self, first, last):
        names = []
        for j in range(first, min(last, len(self.tok))):
            kind, value = self.tok[j][:2]
            after_dot = j > 0 and self.tok[j - 1][1] in (".", "?.")
            is_key = j + 1 < len(self.tok) and self.tok[j + 1][1] == ":" and self.tok[j - 1][1] in ("{", ",")
            if kind == "name" and value not in WORDS and not after_dot and not is_key:
                names.append(var(value))
        return names

    def opaque(self, first):
        return {"type": None, "names": self.names_in(first, self.i)}

    def skip_type(self, *stops):
        """Skip a type annotation up to one of the stop tokens outside brackets."""
        while self.i < len(self.tok) and not self.at(*stops):
            self.i = self.match.get(self.i, self.i) + 1

    # functions
    def function(self, first, name, params_at, body_at):
        """Record a function whose parameter list opens at params_at."""
        slot = len(self.functions)
        self.functions.append(None)
        if self.tok[params_at][1] == "(":
            params = self.split(params_at)
        else:
            params = [self.tok[params_at][1]]
        line = self.tok[first][2]
        self.i = body_at
        if self.at("{"):
            body = self.block()
        else:
            value = self.expression()
            body = [{"type": "IRReturn", "id": make_id("IRReturn", ""), "line": line, "value": value if known(value) else None}]
        name = name or "<anonymous>"
        made = {
            "type": "IRFunction", "name": name, "params": params, "body": body, "file_path": self.file_path,
            "line": line, "is_async": "async" in self.source(first, self.i).lower(),
            "id": make_id("IRFunction", f"{name}({','.join(params)})", self.file_path, "global"),
        }
        self.functions[slot] = made
        return made

    def split(self, open_at):
        """Texts between the top-level commas of a bracket."""
        close, start, parts, j = self.match.get(open_at, len(self.tok)), open_at + 1, [], open_at + 1
        while j <= close:
            if j == close or self.tok[j][1] == ",":
                if j > start:
                    parts.append(self.source(start, j))
                start = j + 1
            j = self.match.get(j, j) + 1
        return parts

    def body_after(self, params_at, arrow):
        """Index of the body after a parameter list (and return type), or None."""
        j = self.match.get(params_at, params_at) + 1
        if j < len(self.tok) and self.tok[j][1] == ":":
            while j < len(self.tok) and self.tok[j][1] not in ("=>", "{", ";", ",", ")", "?"):
                j = self.match.get(j, j) + 1 if self.tok[j][1] != "{" else j
        want = "=>" if arrow else "{"
        if j < len(self.tok) and self.tok[j][1] == want:
            return j + 1 if arrow else j
        return None

    def try_function(self, name=""):
        """A function expression or arrow function at the cursor, else None."""
        first, j = self.i, self.i
        if self.tok[j][1] == "async" and self.peek(1)[1] not in (".", "=", ",", ")", ";"):
            j += 1
        if j >= len(self.tok):
            return None
        kind, value = self.tok[j][:2]
        if value == "function" and kind == "name":
            j += 1
            if self.tok[j][1] == "*":
                j += 1
            if self.tok[j][0] == "name":
                name, j = self.tok[j][1], j + 1
            while j < len(self.tok) and self.tok[j][1] != "(":
                j += 1
            body = self.body_after(j, False) if j < len(self.tok) else None
            return self.function(first, name, j, body) if body is not None else None
        if value == "(" and kind == "op":
            body = self.body_after(j, True)
            return self.function(first, name, j, body) if body is not None else None
        if kind == "name" and j + 1 < len(self.tok) and self.tok[j + 1][1] == "=>":
            return self.function(first, name, j, j + 2)
        return None

    # statements
    def block(self):
        close, body = self.match.get(self.i, len(self.tok)), []
        self.i += 1
        while self.i < close:
            body.extend(self.statement())
        self.i = close + 1
        return body

    def branch_body(self):
        return self.block() if self.at("{") else self.statement()

    def statement(self):
        before, made = self.i, self._statement()
        if self.i == before:
            self.i += 1
        return made

    def _statement(self):
        kind, word, line = self.peek()[:3]
        if self.at("{"):
            return self.block()
        if self.take(";"):
            return []
        if kind != "name":
            return self.expression_statement()
        if word == "export":
            self.take()
            return self.statement() if not self.take("default") else self.default_export()
        if word == "import" and self.peek(1)[1] not in ("(", "."):
            while self.i < len(self.tok) and self.peek()[2] == line and not self.take(";"):
                self.i = self.match.get(self.i, self.i) + 1
            return []
        if word in ("const", "let", "var"):
            self.take()
            return self.declaration()
        if word == "function" or (word == "async" and self.peek(1)[1] == "function"):
            made = self.try_function()
            return [made] if made else []
        if word == "class" or (word == "abstract" and self.peek(1)[1] == "class"):
            self.class_body()
            return []
        if word in ("interface", "enum", "declare", "namespace") and self.peek(1)[0] == "name":
            self.skip_type("{", ";")
            self.i = self.match.get(self.i, self.i) + 1
            return []
        if word == "return":
            self.take()
            value = None if self.at(";", "}") or self.peek()[2] != line else self.expression()
            self.take(";")
            return [{"type": "IRReturn", "id": make_id("IRReturn", ""), "line": line, "value": value if known(value) else None}]
        if word == "if":
            return [self.if_statement(line)]
        if word == "try":
            self.take()
            body = self.block()
            if self.take("catch"):
                if self.at("("):
                    self.i = self.match.get(self.i, self.i) + 1
                body += self.block()
            return body + (self.block() if self.take("finally") else [])
        if word in ("for", "while", "switch"):
            self.take()
            self.take("await")
            self.i = self.match.get(self.i, self.i) + 1
            return self.branch_body()
        if word == "do":
            self.take()
            body = self.branch_body()
            if self.take("while"):
                self.i = self.match.get(self.i, self.i) + 1
            return body
        if word == "case" or (word == "default" and self.peek(1)[1] == ":"):
            self.skip_type(":")
            self.take(":")
            return []
        if word == "throw":
            self.take()
            self.expression()
            self.take(";")
            return []
        return self.expression_statement()

    def default_export(self):
        made = self.try_function("default")
        if made:
            return [made]
        return self.statement()

    def class_body(self):
        self.skip_type("{")
        close = self.match.get(self.i, len(self.tok))
        self.i += 1
        while self.i < close:
            first = self.i
            while self.at("static", "async", "get", "set", "public", "private", "protected", "readonly", "*") and self.peek(1)[1] not in ("(", "="):
                self.i += 1
            if self.peek()[0] in ("name", "str") and self.peek(1)[1] == "(":
                body = self.body_after(self.i + 1, False)
                if body is not None:
                    self.function(first, self.peek()[1], self.i + 1, body)
                    continue
            if self.peek()[0] == "name" and self.peek(1)[1] == "=":
                self.i += 2
                self.expression()
                continue
            self.i = self.match.get(self.i, self.i) + 1
        self.i = close + 1

    def if_statement(self, line):
        self.take()
        close = self.match.get(self.i, self.i)
        self.i += 1
        test = self.expression() if self.i < close else None
        self.i = close + 1
        test = test if known(test) else literal(True, "boolean")
        yes = self.branch_body()
        no = self.branch_body() if self.take("else") else []
        signature = test.get("target") or str(test)
        return {"type": "IRBranch", "id": make_id("IRBranch", signature), "condition": test, "true_body": yes, "false_body": no, "line": line}

    def assign(self, target, value, line):
        return {"type": "IRAssign", "id": make_id("IRAssign", f"{target}="), "target": target, "value": value, "line": line}

    def declaration(self):
        made = []
        while self.i < len(self.tok):
            first, line = self.i, self.peek()[2]
            self.i = self.match.get(self.i, self.i) + 1
            target = self.source(first, self.i)
            if self.take(":"):
                self.skip_type("=", ",", ";", "of", "in")
            if self.take("="):
                value = self.expression(target)
                if known(value) and value["type"] != "IRFunction":
                    made.append(self.assign(target, value, line))
            if not self.take(","):
                break
        self.take(";")
        return made

    def expression_statement(self):
        line = self.peek()[2]
        node = self.expression()
        self.take(";")
        if not known(node):
            return []
        if node["type"] in ("IRAssign", "IRFunction"):
            return [node]
        if node["type"] == "IRCallExpr" and not node["target"].startswith(("unary_", "bin_", "template_concat")):
            args = [a for a in node["args"] if not a.get("loose")]
            made = {"type": "IRCall", "id": make_id("IRCall", node["target"]), "target": node["target"], "args": args, "line": line}
            return [{**made, "receiver": node["receiver"]} if "receiver" in node else made]
        if node["type"] == "IRAccess":
            path = node["path"]
            receiver = access(node["root"], path[:-1]) if len(path) > 1 else node["root"]
            return [{"type": "IRCall", "id": make_id("IRCall", path[-1]), "target": path[-1], "args": [], "receiver": receiver, "line": line}]
        return []

    # expressions
    def expression(self, name=""):
        first, line = self.i, self.peek()[2]
        made = self.try_function(name) if self.i < len(self.tok) else None
        if made:
            return made
        left = self.binary(0)
        if self.at("="):
            target = self.source(first, self.i)
            self.take()
            value = self.expression(target)
            if known(value) and value["type"] != "IRFunction":
                return self.assign(target, value, line)
            return self.opaque(first)
        if self.peek()[1] in ASSIGN and self.peek()[0] == "op":
            self.take()
            self.expression()
            return self.opaque(first)
        if self.at("?"):
            self.take()
            self.expression()
            self.take(":")
            self.expression()
            return self.opaque(first)
        if self.at("as", "satisfies"):
            self.skip_type(")", ",", ";", "]", "}", "=")
            return self.opaque(first)
        return left

    def binary(self, level):
        first, left = self.i, self.unary()
        while self.peek()[0] in ("op", "name") and BINARY.get(self.peek()[1], -1) >= level:
            op = self.peek()[1]
            self.take()
            right = self.binary(BINARY[op] + 1)
            args = [a for a in (left, right) if known(a)]
            left = call_expr(f"bin_{op}", args) if args else self.opaque(first)
        return left

    def unary(self):
        first = self.i
        kind, value = self.peek()[:2]
        if kind in ("op", "name") and value in UNARY:
            self.take()
            inner = self.unary()
            return call_expr(f"unary_{value}", [inner]) if known(inner) else self.opaque(first)
        if self.take("await", "yield"):
            return self.unary()
        if self.take("++", "--", "..."):
            self.unary()
            return self.opaque(first)
        if self.take("new"):
            self.postfix()
            return self.opaque(first)
        node = self.postfix()
        if self.at("++", "--") and self.peek()[2] == self.peek(-1)[2]:
            self.take()
            return self.opaque(first)
        return node

    def postfix(self):
        first, node = self.i, self.primary()
        member = None
        while True:
            if self.at(".", "?.") and (self.peek(1)[0] == "name"):
                self.take()
                prop = self.peek()[1]
                self.take()
                member, root = (node, prop), node if known(node) else var("<unknown>")
                if root["type"] == "IRAccess":
                    node = access(root["root"], [*root["path"], prop])
                else:
                    node = access(root, [prop])
            elif self.at("(") or (self.at("?.") and self.peek(1)[1] == "("):
                callee_end = self.i
                self.take("?.")
                args = self.arguments()
                if member:
                    receiver = member[0] if known(member[0]) else None
                    node = call_expr(member[1], args, receiver)
                else:
                    node = call_expr(self.source(first, callee_end), args)
                member = None
            elif self.at("[") or (self.at("?.") and self.peek(1)[1] == "["):
                self.take("?.")
                self.i = self.match.get(self.i, self.i) + 1
                node, member = self.opaque(first), None
            elif self.at("!") and self.peek(1)[1] in (".", ")", ";", ","):
                self.take()
            elif self.peek()[0] == "tpl" and self.i > first:
                self.take()
                node, member = self.opaque(first), None
            else:
                return node

    def arguments(self):
        close, args = self.match.get(self.i, len(self.tok)), []
        self.i += 1
        while self.i < close:
            first = self.i
            node = self.expression()
            if self.i == first:
                self.i += 1
            if known(node) and node["type"] in ("IRVar", "IRLiteral", "IRAccess", "IRCallExpr"):
                args.append(node)
            else:
                # An unknown form passes on every identifier inside it.
                args.extend({**v, "loose": True} for v in self.names_in(first, self.i))
            self.take(",")
        self.i = close + 1
        return args

    def primary(self):
        first = self.i
        kind, value = self.peek()[:2]
        self.take()
        if kind == "name":
            if value in ("true", "false"):
                return literal(value == "true", "boolean")
            if value == "null":
                return literal(None, "null")
            if value == "class":
                self.class_body()
                return self.opaque(first)
            return self.opaque(first) if value in ("this", "super", "import") else var(value)
        if kind == "str":
            return literal(value.strip("'\"`"), "string")
        if kind == "num":
            try:
                return literal(float(value) if "." in value else int(value), "number")
            except ValueError:
                return literal(0, "number")
        if kind == "tpl":
            parts = []
            for inner in re.findall(r"\$\{((?:[^{}]|\{[^{}]*\})*)\}", value):
                part = FileReader(inner, self.file_path)
                node = part.expression() if part.tok else None
                if known(node) and node["type"] not in ("IRAssign", "IRFunction"):
                    parts.append(node)
            return call_expr("template_concat", parts) if parts else literal(value[:80], "string")
        if value == "(" and kind == "op":
            close = self.match.get(first, len(self.tok))
            node = self.expression() if self.i < close else None
            self.i = close + 1
            return node if known(node) else self.opaque(first)
        if value in ("[", "{") and kind == "op":
            self.members(self.match.get(first, len(self.tok)), value == "{")
        return self.opaque(first)

    def members(self, close, is_object):
        """Walk an array or object literal for the functions inside it."""
        while self.i < close:
            first = self.i
            if is_object and self.peek()[0] in ("name", "str"):
                while self.at("async", "get", "set", "*") and self.peek(1)[1] not in (":", "(", ","):
                    self.i += 1
                name = self.peek()[1]
                body = self.body_after(self.i + 1, False) if self.peek(1)[1] == "(" else None
                if body is not None:
                    self.function(first, name, self.i + 1, body)
                elif self.peek(1)[1] == ":":
                    self.i += 2
                    self.expression(name)
                else:
                    self.expression()
            elif not self.at(","):
                self.expression()
            if self.i == first or self.at(","):
                self.i += 1
        self.i = close + 1


def read_module(text: str, file_path: str, language: str) -> dict:
    """The IR module of one source text; functions in pre-order, first id wins."""
    reader = FileReader(text, file_path)
    while reader.i < len(reader.tok):
        reader.statement()
    functions = {}
    for fn in reader.functions:
        functions.setdefault(fn["id"], fn)
    return {"file_path": file_path, "language": language, "functions": list(functions.values())}
