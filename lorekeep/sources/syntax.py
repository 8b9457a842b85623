"""Syntax of source files as rows: nested functions and classes, calls, imports and exports, with their lines.

One pass over each file on Arrow batches: a lexer that knows the comments and strings of a language, and a stack of
what is open. What stands before an opening brace (before a colon and a deeper indent in Python) says what it opens; brackets
within it count as one token, so nesting of any depth, callbacks and generic types don't disturb it. All that follows
(routes, models, exports, statistics) is DataFrame functions over these rows.

Defined cases: null and empty texts and unknown languages have no rows; what is never closed ends with the file;
closings that nothing opened are passed over; torn strings end with their line. Texts are taken whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass, field
from keyword import iskeyword

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: The form of comments and strings of a language, and the family whose scopes it has.
FAMILIES = {"JavaScript": "js", "TypeScript": "js", "Python": "py", "Go": "go", "Java": "java", "Rust": "rust", "C": "c", "C++": "c"}
_DOUBLE, _SINGLE = r'"(?:\\.|[^"\\\n])*"?', r"'(?:\\.|[^'\\\n])*'?"
_BLOCK, _LINE = r"/\*[\s\S]*?(?:\*/|\Z)", r"//[^\n]*"
_FORMS = {
    "js": (f"{_BLOCK}|{_LINE}", f"{_DOUBLE}|{_SINGLE}"),
    "py": (r"\#[^\n]*", r'(?i:[rbuf]{0,2})(?:"""(?:\\[\s\S]|(?!""")[^\\])*(?:"""|\Z)|' + r"'''(?:\\[\s\S]|(?!''')[^\\])*(?:'''|\Z)|" + f"{_DOUBLE}|{_SINGLE})"),
    "go": (f"{_BLOCK}|{_LINE}", f"{_DOUBLE}|{_SINGLE}|`[^`]*`?"),
    "java": (f"{_BLOCK}|{_LINE}", r'"""(?:\\[\s\S]|(?!""")[^\\])*(?:"""|\Z)|' + f"{_DOUBLE}|{_SINGLE}"),
    "rust": (_LINE, r'b?r(?P<hash>\#*)"[\s\S]*?(?:"(?P=hash)|\Z)|b?"(?:\\[\s\S]|[^"\\])*"?|' + r"b?'(?:\\(?:u\{[^}\n]*\}|x\w\w|.)|[^\\'\n])'"),
    "c": (rf"{_BLOCK}|{_LINE}|(?m:^)[ \t]*\#(?:[^\n\\]|\\[\s\S])*", f"{_DOUBLE}|{_SINGLE}"),
}
#: White space before a token; lines count in Python and Go only, and a directive of C begins with its line.
_GAPS = {"py": r"[^\S\n]*+", "go": r"[^\S\n]*+", "c": r"(?:(?!(?m:^)[ \t]*\#)\s)*+"}
_LEXERS = {
    f: re.compile(rf"{_GAPS.get(f, r'\s*+')}(?:(?P<comment>{c})|(?P<string>{s})|(?P<word>[^\W\d][\w$]*|\$[\w$]*)|(?P<line>\n)|(?P<mark>=>|->|::|==|!=|<=|>=|&&|\|\||\?\.|:=|\d[\w.]*|'\w+|\S)|(?P<end>\Z))")
    for f, (c, s) in _FORMS.items()
}
_RUST_BLOCK = re.compile(r"/\*|\*/")
_TEMPLATE = re.compile(r"(?:\\[\s\S]|[^`\\$]|\$(?!\{))*(`|\$\{|\Z)")
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
#: Words that are never the name of what is called or opened.
_KEYWORDS = frozenset(
    "if for while switch catch return function new typeof await yield do else try finally with import super def class lambda and or not in is elif except raise assert print "
    "func go defer select range match loop unsafe move fn impl where sizeof alignof decltype static_assert synchronized throw case default".split()
)
_DEFINES = frozenset(["fn", "func", "function", "class", "def"])
_BEFORE_EXPRESSION = frozenset(["=", "(", "[", ",", ":", "?", "return", "=>", "&&", "||", "!", "new", "typeof", "void", "await", "yield", "+", "-", "case", "throw", "default", "??", "."])


@dataclass(slots=True)
class Row:
    """Something that a file holds; ``start`` and ``end`` are offsets until lines are told."""

    kind: str
    name: str
    start: int
    end: int
    parent: str = ""
    exported: bool = False
    argument: str | None = None
    attributes: list[tuple[str, int]] = field(default_factory=list)
    body: str | None = None


@dataclass(slots=True)
class Open:
    """An opened bracket: the statement that it stands in, what it opened, whether methods may stand in it, and the names of the scopes up to it."""

    mark: str
    head: list[tuple[str, int, int]]
    row: Row | None = None
    kind: str = ""
    path: str = ""


def tokens(text: str, family: str, skip: list[int]) -> Iterator[tuple[str, int, int]]:
    """``kind, start, end`` of all but white space; templates give their holes as bracketed tokens and then themselves.

    A place that the reader puts into ``skip`` is where it goes on.
    """
    lexer, last, holes, at = _LEXERS[family], "", [], 0
    js, rust = family == "js", family == "rust"
    while at >= 0:
        found, at = lexer.finditer(text, at), -1  # begins anew behind what isn't a token of the lexer
        for m in found:
            kind = m.lastgroup
            start, end = m.span(kind)
            if kind == "end":
                return
            if kind == "mark":
                token = text[start:end]
                if rust and token == "/" and text.startswith("/*", start):
                    depth, at = 1, start + 2
                    while depth and (inner := _RUST_BLOCK.search(text, at)):
                        depth, at = depth + (1 if inner.group() == "/*" else -1), inner.end()
                    at = at if not depth else len(text)
                    yield "comment", start, at
                    break
                if js and token in "/`{}":
                    if token == "/" and (last in _KEYWORDS or not (last[-1:].isalnum() or last[-1:] in ('"', "'", "`", ")", "]", "}", "_", "$"))) and (r := _REGEX.match(text, start)):
                        at = r.end()
                    elif token == "`" or (token == "}" and holes and not holes[-1][1]):
                        if token == "}":
                            yield "close", start, end
                            start = holes.pop()[0]
                        t = _TEMPLATE.match(text, end)
                        at = t.end()
                        if t.group(1) == "${":
                            holes.append([start, 0])
                            yield "open", at - 2, at
                            last = "("
                            break
                    elif holes and token in "{}":
                        holes[-1][1] += 1 if token == "{" else -1
                    if at >= 0:
                        last = text[start:at]
                        yield "string", start, at
                        break
                last = token
            elif js and kind != "comment":
                last = text[start:end]
            yield kind, start, end
            if skip:
                at = skip.pop()
                last = text[at - 1]
                break


def _joined(head: list[tuple[str, int, int]]) -> str:
    return " ".join(t for t, _, _ in head)


def _token_at(s: str, at: int) -> int:
    """Which token of a joined head begins at ``at``."""
    return s.count(" ", 0, at)


_MARKED, _TYPED, _BLANKS = re.compile(r"@ (?!interface)[\w$]+(?: \. [\w$]+)*(?: \(\))?"), re.compile(r"< [^<>]*>"), re.compile(r" +")


def _plain(s: str) -> str:
    """A joined head without type arguments and annotations."""
    if "@" in s:
        s = _MARKED.sub("", s)
    while "<" in s and (t := _TYPED.sub("", s)) != s:
        s = t
    return (_BLANKS.sub(" ", s) if "  " in s else s).strip()


_JS_FUNCTION, _JS_CLASS = re.compile(r"(?:^| )((?:async )?function ([\w$]+)(?: <.*>)? \(\)(?: : .*)?)$"), re.compile(r"(?:^| )((?:abstract )?class ([\w$]+)(?: .*)?)$")
_JS_METHOD = re.compile(r"(?:^| )((?:(?:static|async|get|set|public|private|protected|readonly|override|\*) )*((?:# )?[\w$]+) (?:<.*> )?\(\)(?: : .*)?)$")


def _js(head: list, s: str, around: Open | None) -> tuple[str, str, int] | None:
    m = _JS_FUNCTION.search(s) if "function " in s else None
    m = m or (_JS_CLASS.search(s) if "class " in s else None)
    if m:
        at = _token_at(s, m.start(1))
        before = head[at - 1][0] if at else ""
        if before in _BEFORE_EXPRESSION - {"default"} or (around and around.mark != "{" and not at):
            return ("body", "", at) if "class" in m.group(1).split() else None
        return "class" if "class" in m.group(1).split()[:2] else "function", m.group(2), at
    if around and around.mark == "{" and around.kind in ("class", "body", "object"):
        m = _JS_METHOD.search(s) if "()" in s else None
        if m and m.group(2) not in _KEYWORDS:
            at = _token_at(s, m.start(1))
            if not at or head[at - 1][0] not in _BEFORE_EXPRESSION | {"function", "=>"}:
                return "function", m.group(2).replace(" ", ""), at
    return None


def _java(head: list, s: str, around: Open | None) -> tuple[str, str, int] | None:
    told = _plain(s)
    if m := re.search(r"(?:^| )(?<!@ )(?:class|interface|enum|record) (\w+)(?: [^=]*)?$", told):
        return "class", m.group(1), 0
    if re.search(r"(?:^| )new [\w. ]+\(\)$", told) or "@ interface" in told:
        return "body", "", 0
    if around is None or around.kind not in ("class", "body") or "=" in told.split() or "->" in told.split():
        return None
    m = re.match(r"((?:[\w.]+ |\[\] |\. |\? |& )*)(\w+) \(\)(?: \[\])*(?: throws [\w., ]+)?(?: default .*)?$", told)
    types = [t for t in m.group(1).split() if t not in ("public", "protected", "private", "static", "final", "abstract", "native", "synchronized", "default", "strictfp")] if m else []
    if m and m.group(2) not in _KEYWORDS and (types or (around.row and m.group(2) == around.row.name)):
        return "function", m.group(2), 0
    return ("body", "", 0) if re.search(r"(?:^|, )\w+(?: \(\))?$", told) else None  # of a constant of an enumeration


def _go(head: list, s: str, around: Open | None) -> tuple[str, str, int] | None:
    if m := re.match(r"func (?:\(\) )?(\w+)(?: \[\])? \(\)(?: .*)?$", s):
        return "function", m.group(1), 0
    grouped = around is not None and around.mark == "(" and _joined(around.head) == "type"
    m = re.match(r"(?:type )?(\w+)(?: \[\])? (?:struct|interface)$", s)
    return ("class", m.group(1), 0) if m and (grouped or s.startswith("type ")) else None


def _rust(head: list, s: str, around: Open | None) -> tuple[str, str, int] | None:
    first = 0
    while m := re.match(r"(?:# (?:! )?\[\] )", s[first:]):
        first += m.end()
    at, s = _token_at(s, first), s[first:]
    if m := re.search(r"(?:^| )fn (\w+)(?: <.*>)? \(\)(?: -> .*)?(?: where .*)?$", s):
        return "function", m.group(1), at
    if m := re.match(r"(?:pub (?:\(\) )?)?(?:unsafe )?(struct|enum|trait|union|mod|type) (\w+)", s):
        return "module" if m.group(1) == "mod" else "class", m.group(2), at
    if m := re.match(r"(?:unsafe )?impl(?: <.*?>)? (?:.* for )?(.+?)(?: where .*)?$", s):
        return "class", re.sub(r" (?=[<>,:])|(?<=[<:]) ", "", m.group(1)), at
    return None


def _c(head: list, s: str, around: Open | None) -> tuple[str, str, int] | None:
    if re.search(r'(?:^| )(?:namespace(?: \w+)*|extern "")$', s):
        return "module", s.split()[-1] if not s.endswith('"') else "", 0
    m = re.match(r"(?:template < .* > )?(?:typedef )?(?:struct|class|union|enum)(?: class)?(?: (\w+))?(?: (?:final|:) .*)?$", s)
    if m:
        return "class", m.group(1) or "", 0
    if around is None or around.kind in ("class", "module"):
        m = re.match(r"(?:.* )?(?:[\w*&>]+) (\w+) \(\)(?: (?:const|noexcept|override|final|& ?&?|-> .*|: .*))*$", s)
        if m and m.group(1) not in _KEYWORDS and "=" not in s.split():
            return "function", m.group(1), 0
    return None


_OPENS: dict[str, Callable] = {"js": _js, "java": _java, "go": _go, "rust": _rust, "c": _c}


def _exported(family: str, kind: str, name: str, words: list[str], at: int) -> bool:
    """Does the language show what a head opens to other files?"""
    if kind == "class":
        return family != "c"
    if kind != "function":
        return False
    if family == "js":
        return "export" in words[max(0, at - 2) : at] and words[at - 1] in ("export", "default")
    return name[:1].isupper() if family == "go" else family == "rust" and words[at] == "pub"


# Plain statements, which are told whole and not by their tokens. They begin where a statement begins in a block, and what they leave
# behind is what their tokens would: no brackets but those named here, no comments, no strings that could be torn.
_Q2, _Q1 = r'"(?:\\.|[^"\\\n])*+"', r"'(?:\\.|[^'\\\n])*+'"
_PLAIN = {
    "c": re.compile(r"""(?:[^;{}()\[\]"'/#\\]*+;)++"""),
    # annotations with strings and names, then words up to the semicolon; imports are told by their tokens
    "java": re.compile(rf"""(?:\s*+(?:@(?!interface)[A-Za-z_]\w*+\s*+(?:\((?:[^()"'/@{{}}\[\];]++|(?!\"\"\"){_Q2})*+\)\s*+)?)*+(?!import\b)[^;{{}}()\[\]"'/#@]*+;)++"""),
    # lines that end in a word or a string; types are told by their tokens
    "go": re.compile(rf"""(?:[^\S\n]*+(?:(?!type\b)[^\W\d]\w*+(?:[ \t.*,]*+\w++)*+(?:[ \t]*+(?:`[^`]*+`|{_Q2}))?[ \t\r]*+)?\n)++"""),
    # up to the brace that ends the block
    "rust": re.compile(r"""(?:[^{}()\[\]"'/;#]++|'[A-Za-z_]\w*+(?!'))++(?=\})"""),
}
#: A method of a class without calls and blocks in it.
_PLAIN_METHOD = (
    rf"""\s*+(?!(?:{'|'.join(sorted(_KEYWORDS))})(?![\w$]))([A-Za-z_$][\w$]*+)\s*+\([\w$,\s]*+\)\s*+\{{(?:[^{{}}()\[\]"'`/]++|{_Q2}|{_Q1}|`(?:[^`\\$]++|\\[\s\S]|\$(?!\{{)|\$\{{[\w$.\s]*+\}})*+`)*+\}}"""
)
_METHOD, _METHODS = re.compile(_PLAIN_METHOD), re.compile(f"(?:{_PLAIN_METHOD})++")

_NAMED, _WORD, _STOPS = re.compile(r"[^\W\d]|\$"), re.compile(r"[\w$]"), frozenset("()[]{};,")


def braces(text: str, family: str, kinds: Collection[str] | None = None) -> list[Row]:
    """What a file of a language with braces holds; functions that nobody asks for may be left out."""
    out: list[Row] = []
    skip: list[int] = []
    plain = _PLAIN.get(family)
    stack: list[Open] = []
    head: list[tuple[str, int, int]] = []
    calls: dict[int, Row] = {}  # by the place of the last word of the name
    importing, last_end, imported = False, 0, text.find("import")  # the next place of that word
    inside = lambda: stack[-1].path if stack else ""
    around = lambda: stack[-1] if stack else None

    def pass_plain(end: int) -> int:
        """Tell the plain statements of a block that begin at ``end``; where they end."""
        nonlocal imported
        if importing or not stack or stack[-1].mark != "{":
            return end
        if plain is not None:
            m = plain.match(text, end) if stack[-1].kind != "use" else None
            at = m.end() if m else end
        else:
            at = end
            if stack[-1].kind in ("class", "body"):
                if kinds is not None and "function" not in kinds:
                    if 0 <= imported < end:
                        imported = text.find("import", end)
                    m = _METHODS.match(text, end, imported if imported >= 0 else len(text))
                    at = m.end() if m else end
                parent = stack[-1].path
                while (m := _METHOD.match(text, at)) and text.find("import", at, m.end()) < 0:
                    out.append(Row("function", m.group(1), m.start(1), m.end(), parent))
                    at = m.end()
        if at > end:
            skip.append(at)
            while text[at - 1].isspace():
                at -= 1
        return at

    def opened(end: int) -> Row | None:
        s = _joined(head)
        found = _OPENS[family](head, s, around())
        if not found:
            return None
        kind, name, at = found
        start = head[at][1] if at < len(head) else end
        row = Row(kind, name, start, end, inside())
        if "@" in s or "#" in s:
            row.attributes = [(text[a:z], a) for t, a, z in attributes(0, len(head))]
        called = name.lstrip("#")
        for t, a, _ in head:
            if t == called:
                calls.pop(a, None)
        row.exported = _exported(family, kind, name, [t for t, _, _ in head], at)
        if kind in ("class", "function"):
            out.append(row)
        return row

    def attributes(a: int, z: int) -> Iterator[tuple[str, int, int]]:
        """Annotations of a head: @X, @X(...), #[...]."""
        i = a
        while i < z:
            t, start, _ = head[i]
            if t == "@" and i + 1 < z and head[i + 1][0] != "interface":
                j = i + 1
                while j + 2 < z and head[j + 1][0] == ".":
                    j += 2
                if j + 1 < z and head[j + 1][0] == "()":
                    j += 1
                yield "@", start, head[j][2]
                i = j
            elif t == "#" and i + 1 < z and head[i + 1][0] == "[]":
                yield "#", start, head[i + 1][2]
                i += 1
            i += 1

    def ended(end: int) -> None:
        """A statement ends without a brace."""
        if not head:
            return
        s = _joined(head)
        if family == "java":
            if head[0][0] == "import" and (m := re.match(r"import\s+(?:static\s+)?([\w.]+(?:\.\*)?)", text[head[0][1] : end])):
                out.append(Row("import", m.group(1), head[0][1], end))
            elif around() and around().mark == "{" and around().kind in ("class", "body") and "()" in _plain(s) and (f := _java(head, s, around())) and f[0] == "function":
                opened(end)
        elif family == "rust":
            if (s.startswith("use ") or s.startswith("pub ")) and (m := re.match(r"(?:pub (?:\(\) )?)?use ", s)):
                at = _token_at(s, m.end())
                out.append(Row("import", re.sub(r"\s+", " ", text[head[at][1] : end]).strip(), head[0][1], end))
            elif re.match(r"(?:# \[\] )*(?:pub (?:\(\) )?)?(?:struct|type) ", s):
                opened(end)
        elif family == "go" and (s.startswith("type ") or (around() and around().mark == "(" and _joined(around().head) == "type")):
            told = s.removeprefix("type ")
            if (m := re.match(r"(\w+)(?: \[\])? (?!=)\S", told)) and not re.match(r"\w+(?: \[\])? (?:struct|interface)$", told):
                out.append(Row("class", m.group(1), head[0][1], end, inside(), True, body=text[head[0][1] : end]))

    for kind, start, end in tokens(text, family, skip):
        token = text[start:end]
        if kind == "word" or kind == "mark" and token not in _STOPS:  # most tokens
            if token == "import" and not (head and head[-1][0] == "."):
                importing = family in ("js", "go") and (family == "js" or not stack)
            elif importing and token == "." and family == "js":
                importing = False
            head.append((token, start, end))
            last_end = end
            continue
        if kind == "comment":
            if family == "c" and (m := re.match(r"\s*#\s*include\s+[<\"]([^>\"]*)[>\"]", token)) and m.group(1):
                out.append(Row("import", m.group(1), start, end))
            continue
        if kind == "line":
            if family == "go":
                if head and (head[-1][0] in (")", "()", "[]", '""', "}", "break", "continue", "return") or head[-1][0][-1:].isalnum() or head[-1][0][-1:] == "_"):
                    ended(start)
                    head = []
                importing = importing and bool(stack)
            continue
        if kind == "string":
            if importing and (family == "go" or (head and head[-1][0] in ("from", "import"))):
                out.append(Row("import", token.strip("'\"`"), start, end))
                importing = family == "go"
            if stack and stack[-1].row and stack[-1].row.kind == "call" and stack[-1].row.argument is None:
                stack[-1].row.argument = token[1:-1] if len(token) > 1 and token[-1] == token[0] else token[1:]
            head.append(('""', start, end))
        elif kind == "open" or token in ("(", "["):
            call = None
            if token == "(" and head and _NAMED.match(head[-1][0]) and head[-1][0] not in _KEYWORDS and (len(head) < 2 or head[-2][0] not in _DEFINES) and not (stack and stack[-1].mark == "[" and stack[-1].head and stack[-1].head[-1][0] in ("#", "!")):
                i = len(head) - 1
                while i >= 2 and head[i - 1][0] in (".", "::", "->", "?.") and (_WORD.match(head[i - 2][0]) or head[i - 2][0] in ("()", "[]")):
                    i -= 2
                marked = i and head[i - 1][0] == "@"
                call = Row("call", "".join(text[head[i][1] : head[-1][2]].split()), head[i][1], end, inside())
                if not marked:
                    calls[head[-1][1]] = call
            stack.append(Open("(" if kind == "open" else token, head, call, "", inside()))
            head = []
        elif kind == "close" or token in (")", "]"):
            want = "(" if kind == "close" or token == ")" else "["
            if any(o.mark == want for o in stack) and not (stack[-1].mark == "{" and want != "{"):
                if family == "go":
                    ended(start)
                while (o := stack.pop()).mark != want:
                    head = o.head
                if o.row:
                    o.row.end = end
                begin = start if not o.head else o.head[-1][2]
                head = o.head
                head.append(("()" if want == "(" else "[]", begin, end))
                importing = importing and family != "go"
        elif token == "{":
            if family == "rust" and re.match(r"(?:pub (?:\(\) )?)?use ", _joined(head) + " "):
                stack.append(Open("{", head, None, "use", inside()))
            else:
                row = opened(end)
                last = head[-1][0] if head else ""
                literal = family == "js" and not row and (last in _BEFORE_EXPRESSION - {"=>"} or last in ("default", "...") or (not head and around() and around().mark != "{"))
                path = inside()
                if row and row.name:
                    path = f"{path}.{row.name}" if path else row.name
                stack.append(Open("{", [], row, row.kind if row else "object" if literal else "block", path))
            head = []
            end = pass_plain(end)
        elif token == "}":
            if any(o.mark == "{" for o in stack):
                if family == "go":
                    ended(start)
                while (o := stack.pop()).mark != "{":
                    pass
                if o.row:
                    o.row.end = end
                    if o.row.kind == "class":
                        o.row.body = text[o.row.start : end]
                head = []
                if o.kind == "use":
                    head = [*o.head, ("{}", start, end)]
                else:
                    end = pass_plain(end)
        elif token == ";":
            ended(start)
            head, importing = [], False
            end = pass_plain(end)
        elif token == "," and family == "js" and stack and (stack[-1].mark != "{" or stack[-1].kind == "object"):
            head = []
        else:
            head.append((token, start, end))
        last_end = end
    for o in stack:
        if o.row and o.row.kind in ("class", "function"):
            o.row.end = max(last_end, o.row.start)
            if o.row.kind == "class":
                o.row.body = text[o.row.start :]
    out += calls.values()
    if family == "js":
        out += [Row("import", c.argument, c.start, c.end) for c in calls.values() if c.name == "require" and c.argument]
        if "module.exports" in text:
            out += _module_exports(text)
    return out


def _module_exports(text: str) -> Iterator[Row]:
    """Names of ``module.exports = {a, b: c}`` and ``module.exports = name``, outside of comments."""
    at = text.find("module.exports")
    for m in re.finditer(r"module\.exports\s*=\s*(?:\{([^}]+)\}|(\w+))", _spaced(text)):
        names = [re.split(r"\s+as\s+|\s*:\s*", n.strip())[-1] for n in m.group(1).split(",")] if m.group(1) else [m.group(2)]
        yield from (Row("export", n, at, at, exported=True) for n in names if n)


def _spaced(text: str) -> str:
    """The text with blanks for its comments."""
    parts, at = [], 0
    for kind, start, end in tokens(text, "js", []):
        if kind == "comment":
            parts.append(text[at:start])
            at = end
    return " ".join([*parts, text[at:]])


_NAMED_PY = re.compile(r"[^\W\d]")
_PLAIN_STATEMENTS = frozenset("if for while try with return import from pass del raise assert global nonlocal else elif except finally match case".split())
#: A line that is one statement without strings and comments: a call with its value's names, or words without brackets.
_PLAIN_LINE = re.compile(
    rf"""([ \t]*+)((?!(?:async|class|def|__all__|{'|'.join(sorted(_PLAIN_STATEMENTS))})\b)(?:"""
    r"""(?:[A-Za-z_]\w*+(?:\.[A-Za-z_]\w*+)*+[ \t]*+(?::[ \t]*+[A-Za-z_][\w.]*+[ \t]*+)?=[ \t]*+)?((?:[A-Za-z_]\w*+\.)*+([A-Za-z_]\w*+))(\([^()\[\]{}"'#\\\n;]*+\))[ \t\r]*+"""
    r"""|[A-Za-z_][^()\[\]{}"'#\\\n;@]*+))\n"""
)


def indents(text: str, kinds: Collection[str] | None = None) -> list[Row]:
    """What a Python file holds: statements by their indents, brackets and strings may span lines; calls that nobody asks for may be left out."""
    out: list[Row] = []
    skip: list[int] = []
    with_calls = kinds is None or "call" in kinds
    stack: list[tuple[int, Row, list[str] | None]] = []  # with the statements of a class
    waiting: list[tuple[str, int]] = []  # decorators
    statement: list[tuple[str, int, int]] = []
    depth, last_end = 0, 0
    opened: list[tuple[int, Row | None]] = []
    bodies: list[tuple[Row, list[str]]] = []  # of the classes

    def close(indent: int) -> None:
        while stack and stack[-1][0] >= indent:
            stack.pop()[1].end = last_end

    def finish() -> None:
        nonlocal statement, waiting, last_end
        if not statement:
            return
        words, start, end = [t for t, _, _ in statement], statement[0][1], statement[-1][2]
        line = text.rfind("\n", 0, start) + 1
        indent = len(text[line:start].expandtabs(8))
        close(indent)
        raw = text[start:end]
        first = words[1] if words[0] == "async" and len(words) > 1 else words[0]
        if first == "@" or words[0] == "@":
            waiting.append((raw, start))
        elif first in ("def", "class") and (m := re.match(r"(?:async\s+)?(def|class)\s+(\w+)", raw)):
            row = Row("class" if m.group(1) == "class" else "function", m.group(2), start, end, ".".join(r.name for _, r, _ in stack), m.group(1) == "class", attributes=waiting, body="" if m.group(1) == "class" else None)
            named = start + m.end(2)
            own = []  # rows of this statement are the last ones
            while out and out[-1].start >= start:
                own.append(out.pop())
            out.extend(r for r in reversed(own) if not (r.kind == "call" and r.start < named))
            out.append(row)
            if row.kind == "class":
                bodies.append((row, []))
            stack.append((indent, row, bodies[-1][1] if row.kind == "class" else None))
            waiting = []
        else:
            waiting = []
            if first == "from" and (m := re.match(r"from\s+(\.*[\w.]*)\s*import\b", raw)):
                out.append(Row("import", m.group(1), start, end))
            if first == "__all__" and (m := re.match(r"__all__\s*(?::[^=]*)?=\s*\[([\s\S]*)\]$", raw)):
                out.extend(Row("export", n, start, end, exported=True) for n in re.findall(r"[\"']([^\"']+)[\"']", m.group(1)))
            if stack and stack[-1][1].kind == "class" and first not in _PLAIN_STATEMENTS:
                stack[-1][2].append(raw + "\x00")
        last_end = end
        statement = []

    def pass_plain(at: int) -> None:
        """Tell the plain lines that begin at ``at``."""
        nonlocal waiting, last_end
        begin, before = at, None
        while m := _PLAIN_LINE.match(text, at):
            indent, raw, name, word, _ = m.groups()
            if word and iskeyword(word):
                break
            if indent != before:  # lines of one indent after another close nothing
                before = indent
                close(len(indent.expandtabs(8)))
                inner = stack[-1][1] if stack else None
                path = "" if inner is None else f"{inner.parent}.{inner.name}" if inner.parent else inner.name
                own = stack[-1][2] if stack else None  # of a class
            raw = raw.rstrip()
            if name and with_calls:
                out.append(Row("call", name, m.start(3), m.end(5), path))
            if own is not None:
                own.append(raw + "\x00")
            last_end = at + len(indent) + len(raw)
            at = m.end()
        if at > begin:
            waiting = []
            skip.append(at)

    for kind, start, end in tokens(text, "py", skip):
        token = text[start:end]
        if kind == "comment":
            continue
        if kind == "word":
            statement.append((token, start, end))
            continue
        if kind == "line":
            if not depth and text[start - 1 : start] != "\\":
                finish()
                pass_plain(end)
            continue
        if token == ";" and not depth:
            finish()
            continue
        if kind == "string" and opened and opened[-1][1] is not None and opened[-1][0] == depth and opened[-1][1].argument is None:
            opened[-1][1].argument = re.sub(r"^\w*(?:'''|\"\"\"|'|\")|(?:'''|\"\"\"|'|\")$", "", token)
        if token in ("(", "[", "{") and kind == "mark":
            depth += 1
            call = None
            if token == "(" and statement and statement[-1][2] == start and _NAMED_PY.match(statement[-1][0]) and not iskeyword(statement[-1][0]):
                i = len(statement) - 1
                while i >= 2 and statement[i - 1][0] == "." and (re.match(r"\w", statement[i - 2][0]) or statement[i - 2][0] in (")", "]")):
                    i -= 2
                if statement[0][0] != "@":
                    indent = len(text[text.rfind("\n", 0, statement[0][1]) + 1 : statement[0][1]].expandtabs(8))
                    call = Row("call", text[statement[i][1] : start].strip().lstrip(")]"), statement[i][1], end, ".".join(r.name for d, r, _ in stack if d < indent))
                    out.append(call)
            opened.append((depth, call))
        elif token in (")", "]", "}") and kind == "mark" and depth:
            depth -= 1
            _, call = opened.pop()
            if call:
                call.end = end
        statement.append((token if kind != "string" else '""', start, end))
    finish()
    close(0)
    for row, told in bodies:
        row.body = "".join(told)
    return out


def rows_of(text: str | None, language: str | None, kinds: Collection[str] | None = None) -> list[tuple]:
    """``kind, name, line, end_line, parent, exported, argument, attributes, body`` of a file, by place; of all kinds or of some."""
    family = FAMILIES.get(language or "")
    if not text or not family:
        return []
    found = indents(text, kinds) if family == "py" else braces(text, family, kinds)
    if kinds is not None:
        found = [r for r in found if r.kind in kinds]
    if not found:
        return []
    ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 10)
    lines = lambda at: (np.searchsorted(ends, np.array(at, np.int64) - 1, "right") + 1).tolist()
    found.sort(key=lambda r: (r.start, -r.end, r.kind, r.name))
    first, last = lines([r.start for r in found]), lines([max(r.start, r.end - 1) for r in found])
    marks = lambda r: list(zip([t for t, _ in r.attributes], lines([a for _, a in r.attributes]), strict=True)) if r.attributes else []
    return [(r.kind, r.name, a, z, r.parent, r.exported, r.argument, marks(r), r.body) for r, a, z in zip(found, first, last, strict=True)]


_ATTRIBUTES = pa.list_(pa.struct([("text", pa.string()), ("line", pa.int32())]))
_SCHEMA = "kind string, name string, line int, end_line int, parent string, exported boolean, argument string, attributes array<struct<text:string,line:int>>, body string"
_ARROW = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.string(), _ATTRIBUTES, pa.string())


def syntax(files: DataFrame, kinds: Collection[str] | None = None, bodies: bool = True) -> DataFrame:
    """Rows of ``path, language`` and what each file (``path, language, text``) holds; nothing is shuffled.

    Of all kinds (import, export, class, function, call) or of some; without ``bodies`` their column is null.
    """
    names = ["path", "language", *(f.name for f in _parse_datatype_string(_SCHEMA).fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                own = b.slice(at, 64)
                told = [(p, g, *r) for p, g, t in zip(*(own.column(c).to_pylist() for c in ("path", "language", "text")), strict=True) for r in rows_of(t, g, kinds)]
                columns = [pa.array([r[i] for r in told], t) for i, t in enumerate((pa.string(), pa.string(), *(_ARROW if bodies else _ARROW[:-1])))]
                yield pa.RecordBatch.from_arrays(columns if bodies else [*columns, pa.nulls(len(told), pa.string())], names)

    schema = StructType([StructField("path", files.schema["path"].dataType), *_parse_datatype_string("language string, " + _SCHEMA).fields])
    return files.select("path", "language", "text").mapInArrow(run, schema)


def file_symbols(rows: DataFrame) -> DataFrame:
    """``path, language, imports, exports, functions`` of each file that holds something: distinct names, and functions with their lines."""
    place = F.struct(F.col("line").alias("at"), F.col("name").alias("name"))
    names = lambda where: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(where, place))), lambda x: x["name"]))
    function = F.struct("line", "end_line", "name", "parent")
    return rows.groupBy("path", "language").agg(
        names(F.col("kind") == "import").alias("imports"), names(F.col("exported")).alias("exports"), F.array_sort(F.collect_list(F.when(F.col("kind") == "function", function))).alias("functions")
    )


# Names of what serves routes, and patterns of routes and of models, by language.
_SERVERS = ("app", "router", "server", "this.app", "this.router", "fastapi", "api", "routerv1")
_JS_VERB, _GO_VERB = r"(?i)\.(get|post|put|patch|delete|head|options|all)\b", r"\.(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\b"
_PY_ROUTE = r"(?i)@[\w.]+\.(get|post|put|patch|delete|head|options)\s*\(\s*['\"]([^'\"]+)['\"]"
_JAVA_ROUTE = r"@(?:RequestMapping|GetMapping|PostMapping|PutMapping|DeleteMapping|PatchMapping)"
_JAVA_PATH = _JAVA_ROUTE + r"\s*\(\s*[\"']([^\"']+)[\"']\s*\)"
_JPA, _JPA_FIELD = r"@(?:Entity|Table)\b", r"@(?:Column|Id|JoinColumn|OneToMany|ManyToOne|ManyToMany|OneToOne)\b"
_DIESEL = r"(?i)derive\([^)]*(?:Queryable|Insertable|Table)[^)]*\)|#\[table_name\s*="


def _routes() -> Column:
    """An array of ``method, route, path, line, handler``: the web routes that a row tells."""
    object_ = F.lower(F.regexp_replace("name", r"(?i)\.[\w$]+$", ""))
    served = object_.isin(*_SERVERS) | object_.contains("app") | object_.contains("router") | object_.contains("server")
    js, go = F.col("language").isin("JavaScript", "TypeScript"), F.col("language") == "Go"
    verb = F.when(js & F.col("name").rlike(_JS_VERB) & served, F.upper(F.regexp_extract("name", _JS_VERB, 1))).when(go & F.col("name").rlike(_GO_VERB), F.regexp_extract("name", _GO_VERB, 1))
    told = lambda method, route, line, handler=None: F.struct(method.alias("method"), route.alias("route"), F.col("path").alias("path"), line.alias("line"), F.lit(handler).cast("string").alias("handler") if handler is None else handler.alias("handler"))
    # Python: the last decorator speaks, the first one's line counts.
    last = F.element_at("attributes", -1)["text"]
    python = told(F.upper(F.regexp_extract(last, _PY_ROUTE, 1)), F.regexp_extract(last, _PY_ROUTE, 2), F.col("attributes")[0]["line"], F.col("name"))
    route = lambda a: F.regexp_extract(a["text"], _JAVA_PATH, 1)
    marked = F.filter("attributes", lambda a: a["text"].contains("(") & a["text"].rlike(_JAVA_ROUTE) & (route(a).startswith("/") | (route(a) == "")))
    method = lambda a: F.when(a["text"].rlike("@(Get|Post|Put|Delete|Patch)Mapping"), F.upper(F.regexp_extract(a["text"], "@(Get|Post|Put|Delete|Patch)Mapping", 1))).otherwise("REQUEST")
    java = F.transform(marked, lambda a: told(method(a), F.when(route(a) == "", "/").otherwise(route(a)), a["line"]))
    scope = F.col("kind").isin("function", "class") & (F.size("attributes") > 0)
    return (
        F.when((F.col("kind") == "call") & F.col("argument").startswith("/") & verb.isNotNull(), F.array(told(verb, F.col("argument"), F.col("line"))))
        .when(scope & (F.col("language") == "Python") & last.rlike(_PY_ROUTE), F.array(python))
        .when(scope & (F.col("language") == "Java"), java)
    )


def routes(rows: DataFrame) -> DataFrame:
    """``method, route, path, line, handler`` of web routes: calls on servers, and decorators or annotations bound to a scope; the rows are read once."""
    return rows.where("kind in ('call', 'function', 'class') and (startswith(argument, '/') or size(attributes) > 0)").select(F.inline(_routes()))


def _model_of() -> Column:
    """``framework, field_count`` of the database model that a row tells, from the body and attributes of a class."""
    body, marks = F.coalesce("body", F.lit("")), F.array_join(F.transform("attributes", lambda a: a["text"]), "\n")
    lang = F.col("language")
    members = F.filter(F.split(body, "\x00"), lambda m: m.rlike(r"=|Column\("))
    return (
        F.when((lang == "Python") & body.contains("__tablename__"), _model("sqlalchemy", F.size(members)))
        .when((lang == "Go") & body.rlike("(?i)gorm:|db:") & body.rlike(r"^(?:type\s+)?\w+(?:\[[^\]]*\])?\s+struct\b"), _model("gorm", F.size(F.filter(F.split(body, "\n"), lambda m: m.rlike("`[^`]*:")))))
        .when((lang == "Java") & F.concat(marks, body).rlike(_JPA), _model("jpa", F.regexp_count(body, F.lit(_JPA_FIELD))))
        .when((lang == "Rust") & F.concat(marks, body).rlike(_DIESEL), _model("diesel", F.regexp_count(body, F.lit(r"(?m)^\s*pub\s+(?!struct\b)\w+"))))
    )


def schemas(rows: DataFrame) -> DataFrame:
    """``name, framework, path, line, field_count`` of database models."""
    return rows.where("kind = 'class'").withColumn("m", _model_of()).where("m is not null").select("name", "m.framework", "path", "line", "m.field_count")


def _model(framework: str, fields: Column) -> Column:
    return F.struct(F.lit(framework).alias("framework"), fields.cast("int").alias("field_count"))


def graph_stats(files: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: files, their languages, import edges, routes and models; the rows are read once."""
    counts = files.groupBy("language").agg(F.count("*").alias("n")).agg(F.sum("n").alias("files"), F.count("*").alias("languages"))
    imports = F.col("kind") == "import"
    model = F.when(F.col("kind") == "class", _model_of()).isNotNull()
    each = rows.where("kind in ('import', 'class') or startswith(argument, '/') or size(attributes) > 0").select(
        F.when(imports, F.struct("path", "name")).alias("edge"), F.when(F.col("kind").isin("call", "function", "class"), F.coalesce(F.size(_routes()), F.lit(0))).otherwise(0).alias("routes"), model.cast("long").alias("models")
    )
    found = each.groupBy("edge").agg(F.sum("routes").alias("routes"), F.sum("models").alias("models"))
    none = F.lit(0).cast("long")
    return counts.join(found.agg(F.count("edge").alias("edges"), F.coalesce(F.sum("routes"), none).alias("routes"), F.coalesce(F.sum("models"), none).alias("models")))
