"""The token tier of brace languages: what brackets enclose, with strings and comments out of the way.

One pass over a file blanks strings and comments (same length, same lines) and matches brackets on a stack.  It
gives *segments*: what stands before a ``{`` with the lines up to its ``}`` (a block), and what ends at a ``;`` or,
where the language has none, at a line's end (a statement).  What a segment declares, who its parent is and
who owns a call are questions for ``operators.declarations``, which answers them on tables.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.scratch import spread

LANGUAGES = ("typescript", "go", "rust", "java", "csharp", "cpp", "php", "swift", "zig")
#: Brackets of a file by which its error ratio is judged, and the ratio from which its segments are not trusted.
SAMPLE, BROKEN = 2000, 0.5
#: Segments, and letters of the files that they come from, after which a worker hands its rows on.
ROWS, LETTERS = 8192, 1 << 20
SEGMENTS = "path string, language string, kind string, item int, up int, ups array<int>, header string, raw string, comment string, start_line int, end_line int, head int, brackets int, errors int"

_COMMENT, _STRING, _CHAR = r"//[^\n]*|/\*.*?(?:\*/|\Z)", r'"(?:[^"\\\n]|\\.)*"?', r"'(?:[^'\\\n]|\\.)+'"
_BLANK = {
    "typescript": rf"{_COMMENT}|`(?:[^`\\]|\\.)*`|{_STRING}|'(?:[^'\\\n]|\\.)*'",
    "go": rf"{_COMMENT}|`[^`]*`|{_STRING}|{_CHAR}",
    "rust": rf'{_COMMENT}|\br(?P<hash>#*)".*?"(?P=hash)|"(?:[^"\\]|\\.)*"|' + r"'(?:\\.[^'\n]*|[^'\\\n])'",
    "java": rf'{_COMMENT}|""".*?"""|{_STRING}|{_CHAR}',
    "csharp": rf'{_COMMENT}|^[ \t]*#[^\n]*|\$?@\$?"(?:[^"]|"")*"|""".*?"""|{_STRING}|{_CHAR}',
    "cpp": rf"{_COMMENT}|^[ \t]*#(?:[^\n\\]|\\.)*|{_STRING}|{_CHAR}",
    "php": rf"\A.*?<\?(?:php\b|=)?|\?>.*?(?:<\?(?:php\b|=)?|\Z)|{_COMMENT}|#(?!\[)[^\n]*|<<<['\"]?(?P<here>\w+)['\"]?\n.*?\n[ \t]*(?P=here)\b|" + r'"(?:[^"\\]|\\.)*"|' + r"'(?:[^'\\]|\\.)*'",
    "swift": rf'{_COMMENT}|""".*?"""|{_STRING}',
    "zig": rf"//[^\n]*|\\\\[^\n]*|{_STRING}|{_CHAR}",
}
_TOKENS = {k: re.compile(rf"(?P<blank>{v})|(?P<label>\b(?:public|private|protected)\s*:(?!:))|(?P<mark>[\[\](){{}};\n{',' * (k == 'zig')}])", re.M | re.S) for k, v in _BLANK.items()}
#: (Fields of Zig end with a comma, before a function may follow.)
_CLOSES = {")": "(", "]": "[", "}": "{"}
#: A line goes on after these characters, or before those.
_LINES = {"go": ("", ""), "swift": (",:=(&|+-*/<.", "{.?:&|="), "typescript": (",:=([{.?&|+-*/<>", "{.?:&|=+*/<>,)]")}
_WORTH = re.compile(r"\w\s*(?:<[^;]*>)?\(|=>|\b(?:struct|enum|type|trait|class|interface|protocol|union)\b")
#: A name before a bracket; what is made by ``new`` is no call but in PHP.
_CALL = re.compile(r"(?<!\w)(new\s+)?(?:[A-Za-z_]\w*\.)*?([A-Za-z_]\w*)\s*(?:<[\w\s,.?&:\[\]]*>)?\(")
_ELEMENT = re.compile(r"(<)([A-Z]\w*)\b")
_SPACE = re.compile(r"\S")


def blanked(content: str, language: str) -> str:
    """The content with strings and comments made spaces."""
    return _TOKENS[language].sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m["blank"] is not None else m[0], content)


def segments(content: str, language: str) -> Iterator[tuple]:
    """Rows of SEGMENTS from ``kind`` on."""
    code = blanked(content, language)
    breaks = [m.start() for m in re.finditer("\n", code)]
    line = lambda at: bisect_right(breaks, at - 1) + 1
    stack: list[tuple[str, int, int, int]] = []  # bracket, item of a brace, where its header began, number of the bracket
    rows: list[list] = []
    spans: list[tuple[int, int]] = []  # of headers
    held: list[tuple[int, tuple[int, ...]]] = [(0, ())]  # enclosing items from a place on
    ups: tuple[int, ...] = ()
    begin = brackets = errors = 0

    def put(kind: str, end: int) -> int:
        found = _SPACE.search(code, begin, end)
        start = found.start() if found else end
        raw = start
        while language == "rust" and code.startswith("#[", start) and (close := code.find("]", start, end)) >= 0:  # attributes stand before a declaration
            start = found.start() if (found := _SPACE.search(code, close + 1, end)) else end
        before = content[begin:raw].strip()
        rows.append([kind, len(rows), ups[-1] if ups else -1, list(ups), code[start:end], content[raw:end], before, line(start), line(end), None])
        spans.append((start, end))
        return len(rows) - 1

    for m in _TOKENS[language].finditer(content):
        at = m.start()
        if m["blank"] is not None:
            continue
        inside = stack[-1][0] if stack else "{"
        if m["label"] is not None:
            if language == "cpp" and inside == "{":
                put("label", m.end() - 1)
                begin = m.end()
            continue
        c = m["mark"]
        if c in "([":
            brackets += 1
            stack.append((c, -1, begin, brackets))
        elif c == "{":
            brackets += 1
            item = put("block", at)
            stack.append((c, item, begin, brackets))
            ups, begin = (*ups, item), at + 1
            held.append((at, ups))
        elif c in _CLOSES:
            brackets += 1
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == _CLOSES[c]), None)
            if depth is None:
                errors += brackets <= SAMPLE
                continue
            errors += sum(s[3] <= SAMPLE for s in stack[depth + 1 :])
            if inside == "{" and language in _LINES and _WORTH.search(code, begin, at):  # ended by the bracket alone
                put("statement", at)
            for bracket, item, started, _ in reversed(stack[depth:]):
                if bracket == "{":
                    rows[item][8] = line(at)
                    ups = ups[:-1]
                begin = started
            del stack[depth:]
            if c == "}":
                begin = at + 1
                held.append((at, ups))
        elif inside == "{":
            if c == "\n":
                if language not in _LINES:
                    continue
                after, before = _LINES[language]
                last, follows = code[begin:at].rstrip()[-1:], _SPACE.search(code, at)
                if not last or last in after or follows and follows[0] in before:
                    continue
            if _WORTH.search(code, begin, at):
                put("statement", at)
            begin = at + 1
    errors += sum(s[3] <= SAMPLE for s in stack)
    for _, item, _, _ in stack:  # never closed: to the end
        if item >= 0:
            rows[item][8] = line(len(code))
    starts, places = sorted((s, k) for k, (s, _) in enumerate(spans)), [at for at, _ in held]
    for pattern in (_CALL, _ELEMENT) if language == "typescript" else (_CALL,):
        for m in pattern.finditer(code):
            if m[1] and m[1] != "<" and language != "php":
                continue
            k = bisect_right(starts, (m.start(), len(rows))) - 1
            head = starts[k][1] if k >= 0 and m.start() < spans[starts[k][1]][1] else None
            own = held[bisect_right(places, m.start()) - 1][1]
            rows.append(["call", -1, own[-1] if own else -1, list(own), m[2], None, None, line(m.start(2)), line(m.start(2)), head])
    yield "file", -1, -1, [], None, None, None, 1, len(breaks) + 1, None, min(brackets, SAMPLE), errors
    for row in rows:
        yield (*row, None, None)


def parsed(files: DataFrame) -> DataFrame:
    """SEGMENTS of files (path, language, content) of LANGUAGES; a row of kind ``file`` has its brackets and errors."""
    names = [f.split(" ")[0] for f in SEGMENTS.split(", ")]
    kinds = {"int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    schema = pa.schema([(f.split(" ", 1)[0], kinds[f.split(" ", 1)[1]]) for f in SEGMENTS.split(", ")])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for n, c in zip(names, zip(*rows, strict=True), strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, letters = [], 0  # many files to a batch
        for batch in batches:
            for path, language, content in zip(*batch.columns, strict=True):
                path, language, content = path.as_py(), language.as_py(), content.as_py()
                rows += ((path, language, *row) for row in segments(content, language))
                letters += len(content)
                if len(rows) >= ROWS or letters >= LETTERS:
                    yield packed(rows)
                    rows, letters = [], 0
        if rows:
            yield packed(rows)

    wanted = files.where(f"content is not null and language in ({', '.join(map(repr, LANGUAGES))})").select("path", "language", "content")
    return spread(wanted, "path").mapInArrow(run, SEGMENTS)
