"""Units of planted source texts, and any text at all."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.functions import units
from quarry.operators import chunking

PYTHON = (
    '"""doc\n'
    'def no(): pass\n'
    '"""\n'
    'from __future__ import annotations\n'
    'import os; import sys\n'
    'x = """\n'
    'def inside():\n'
    '""" + f(\n'
    '  a,\n'
    'def_ = 3)\n'
    'def one(a,\n'
    'b):\n'
    "    s = '''\n"
    'at column 0\n'
    "'''\n"
    '    return a  # c\n'
    '\n'
    '# comment\n'
    '    \n'
    'if x:\n'
    '    def two():\n'
    '        pass\n'
    '    import y\n'
    'else:\n'
    '    class Z:\n'
    '        def m(self): pass\n'
    '@dec(1,\n'
    '2)\n'
    '@other\n'
    'async def three():\n'
    '    """x"""\n'
    '\n'
    '    y = 1\n'
    'try:\n'
    '    from a import (b,\n'
    '      c)\n'
    'except E: pass\n'
    'class Four: x = 1\n'
    'def last():\n'
    '\tif 1:\n'
    '\t\treturn r"\\"\n'
)
SCRIPT = (
    "import a from 'a'\n"
    'import {b,\n'
    '  c} from "c";\n'
    'const s = `\n'
    'function no() {}\n'
    '${ {a: `class X {`} }\n'
    '`;\n'
    '/* function no() {} */ // class Y {\n'
    'export const x = 1,\n'
    '  y = 2\n'
    'export default function foo() { return /}{/g.test("}") }\n'
    'function decl(a, {b}) {\n'
    'return 1\n'
    '}\n'
    'const f = function named() { return {a() {}} };\n'
    'const g = async (a, b) => {\n'
    '  return a\n'
    '}, h = x => x + 1\n'
    'const o = { m(a) { return 1 }, get v() { return 2 }, n: function() {}, k: a => a, [z]() {} }\n'
    'class A extends B {\n'
    '  m() { function inner() {} }\n'
    '}\n'
    'const C = class { p() {} static async q() { } }\n'
    'call(function () { x }, () => 1);\n'
    'if (a) { function nested() {} }\n'
    'async function af() {}\n'
    'foo.function()\n'
    'export { x, y }\n'
)
TYPED = (
    'interface I { a: string; m(): void }\n'
    'type T = { a: number } | string\n'
    'type U<X> =\n'
    '  | X\n'
    '  | null;\n'
    'export interface E { x: 1 }\n'
    'abstract class Q { private m(a: string): {x: number} { return {x: 1} } }\n'
    'const f = (a: string): string => a\n'
    'function g<T>(a: T): { a: T } { return {a} }\n'
    'let type = 3\n'
)


def told(text, scan):
    return [(kind, name, first, last) for kind, name, first, last, _ in units.line_numbers(text, scan(text))]


def test_python_units():
    assert told(PYTHON, units.python_units) == [
        ("import_statement", None, 5, 5),
        ("import_statement", None, 5, 5),
        ("function_definition", "one", 11, 16),
        ("function_definition", "two", 21, 22),
        ("import_statement", None, 23, 23),
        ("class_definition", "Z", 25, 26),
        ("decorated_definition", None, 27, 33),
        ("import_from_statement", None, 35, 36),
        ("class_definition", "Four", 38, 38),
        ("function_definition", "last", 39, 41),
    ]
    contents = [c for *_, c in units.line_numbers(PYTHON, units.python_units(PYTHON))]
    assert contents[2].startswith("def one(a,\nb):") and contents[2].endswith("return a") and contents[3] == "def two():\n        pass"


def test_a_function_with_a_string_at_column_0_is_one_unit():
    text = 'def f():\n    x = """\ndef g(): pass\n"""\n    return x\n'
    assert told(text, units.python_units) == [("function_definition", "f", 1, 5)]


def test_script_units():
    assert told(SCRIPT, units.javascript_units) == [
        ("import_statement", None, 1, 1),
        ("import_statement", None, 2, 3),
        ("export_statement", None, 9, 10),
        ("export_statement", None, 11, 11),
        ("function_declaration", "decl", 12, 14),
        ("function_expression", "named", 15, 15),
        ("arrow_function", None, 16, 18),
        ("arrow_function", None, 18, 18),
        ("method_definition", "m", 19, 19),
        ("method_definition", "v", 19, 19),
        ("function_expression", None, 19, 19),
        ("arrow_function", None, 19, 19),
        ("method_definition", "[z]", 19, 19),
        ("class_declaration", "A", 20, 22),
        ("method_definition", "p", 23, 23),
        ("method_definition", "q", 23, 23),
        ("function_expression", None, 24, 24),
        ("arrow_function", None, 24, 24),
        ("function_declaration", "nested", 25, 25),
        ("function_declaration", "af", 26, 26),
        ("export_statement", None, 28, 28),
    ]


def test_typed_units():
    assert told(TYPED, units.typescript_units) == [
        ("interface_declaration", "I", 1, 1),
        ("type_alias_declaration", "T", 2, 2),
        ("type_alias_declaration", "U", 3, 5),
        ("export_statement", None, 6, 6),
        ("class_declaration", "Q", 7, 7),
        ("arrow_function", None, 8, 8),
        ("function_declaration", "g", 9, 9),
    ]


PIECES = ["def f(", "class A:", "\n", "    ", '"""', "'", '"', "\\", "#", "@d", "{", "}", "(", ")", "[", "]", "`", "${", "=>", "function", "import", "export", "/", "*", "//", "/*", "async", "x", ",", ";", ":", "=", ".", " ", "interface", "type", "\r\n", "é"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40).map("".join), st.sampled_from(sorted(units.SCANNERS)))
def test_any_text_gives_units_in_order(text, language):
    at = 0
    for kind, _, start, end in units.SCANNERS[language](text):
        assert at <= start < end <= len(text) and kind
        at = end


@pytest.mark.parametrize("text", ["(" * 50_000, "{" * 50_000, "a => " * 20_000, '"""' + "x\n" * 200_000, "`${" * 20_000, "def f():\n" + "    x = (1,\n" * 50_000, "x.y(" * 30_000])
def test_long_texts_take_linear_time(text):
    for scan in units.SCANNERS.values():
        assert sum(1 for _ in scan(text)) <= 20_001


def test_chunks_of_source_texts(spark):
    body = "".join(f"    value_{i} = {i}\n" for i in range(80))
    text = f"import os\n\nif True:\n    def long():\n{body.replace('    ', '        ')}\n"
    df = spark.createDataFrame([(1, "python", text), (2, "javascript", SCRIPT), (3, "typescript", "1 + 1"), (4, "python", "")], "doc_id long, language string, text string")
    rows = chunking.chunk_files(df).collect()
    own = sorted((r.chunk_no, r.start_line, r.end_line) for r in rows if r.doc_id == 1 and r.kind == "function_definition")
    assert len(own) > 1 and own[0][1] == 4 and own[-1][2] == 84
    assert {r.kind for r in rows if r.doc_id in (3, 4)} == {"text"}
    assert {r.kind for r in rows if r.doc_id == 2} >= {"function_expression", "method_definition"}
    for r in chunking.structural_units(df).where("doc_id = 2").collect():
        assert r.content in SCRIPT and re.search(r"\S", r.content)
