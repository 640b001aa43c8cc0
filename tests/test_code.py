from pyspark.sql import functions as F

from lodegraph.functions import code


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


def test_declarations(spark):
    rows = [
        ("a.py", "python", "import os\nclass A(B):\n    def run(self):\n        pass\n# class No\nasync def main():\n    pass"),
        ("b.ts", "ts", "export class C {\n}\nexport interface D {}\nconst f = async (x) => x\nfunction g() {}"),
        ("c.go", "go", "type T struct {\nfunc (t *T) Do(x int) {\nfunc Free() {"),
        ("d.rs", "rust", "pub struct S;\n    pub(crate) async fn go() {}"),
        ("e.java", "java", "public final class E {\n  private static List<String> all(int a) {\n    return x;\n  }\n}"),
        ("f.txt", "unknown", "class Nope"),
    ]
    got = {(r["path"], r["line"], r["kind"], r["name"], r["owner"]) for r in code.declarations(spark.createDataFrame(rows, "path string, language string, text string")).collect()}
    assert got == {
        ("a.py", 2, "class", "A", None), ("a.py", 3, "method", "run", "A"), ("a.py", 6, "function", "main", None), ("b.ts", 1, "class", "C", None), ("b.ts", 3, "type", "D", None), ("b.ts", 4, "function", "f", None), ("b.ts", 5, "function", "g", None),
        ("c.go", 1, "type", "T", None), ("c.go", 2, "method", "Do", "T"), ("c.go", 3, "function", "Free", None), ("d.rs", 1, "type", "S", None), ("d.rs", 2, "function", "go", None), ("e.java", 1, "class", "E", None), ("e.java", 2, "method", "all", "E"),
    }


def test_license_headers(spark):
    f = code.without_license
    assert one(spark, "/* Copyright me */\ncode", f) == "code"
    assert one(spark, "// Licensed under X\n// more\ncode // Copyright", f) == "code // Copyright"
    assert one(spark, "/* A module about license plates */\ncode", f) == "/* A module about license plates */\ncode"
    assert one(spark, "code\n/* Copyright me */", f) == "code\n/* Copyright me */"
    assert one(spark, "", f) == ""
    assert one(spark, "// SPDX-License-Identifier: EPL-2.0\ncode", f) == "code"
    assert one(spark, "\n\n/*\n * Proprietary  and\tconfidential\n */ rest\ncode", f) == "code"
    assert one(spark, "# (C) 2020 us\n# more\n\ncode", f) == "\ncode"
    assert one(spark, "** Licence by the mile\ncode", f) == "code"


def test_bodies_and_imports(spark):
    assert one(spark, "import x from 'y'\n\n\n\na  \n\n\n\nb\n\n", code.clean_body) == "a\n\nb"
    assert one(spark, "import {a} from 'vue'\nimport b from '../x/Types.ts'\nimport './style.css'\nconst q = require('fs')\nusing haystack::Dict\nfrom os.path import join\nimport re\nimport {c} from 'vue'", code.imports) == "vue, Types, style, fs, haystack, os, re"
    assert one(spark, "nothing", code.imports) == ""
    assert one(spark, "using haystack::Foo\nusing sys\nimport x from './b'\nimport os\nfrom z.a import q", code.imports) == "haystack, b, os, z"
    assert one(spark, "import '" + "p" * 100 + "'\nimport '" + "q" * 40 + "'\nimport 'r'", code.imports) == "p" * 100  # the first that is too much ends the list
    assert one(spark, "export const a = 'b'\nconst c = 'd'\nimportant('e')\nexport * from \"f\"", code.imports) == "f"
    assert one(spark, "using sys\nusing x is fine\nfrom a import b\nconst q = require('z')\nlet y = 1\nexport { a } from 'b'", code.clean_body) == "using x is fine\nfrom a import b\nlet y = 1"
    long = "\n".join(f"import a{i} from 'package-number-{i}'" for i in range(20))
    assert len(one(spark, long, code.imports)) <= 120


def test_statement_chunks_cover_without_a_gap(spark):
    text = "\n".join(x for i in range(30) for x in (f"head {i}", "  body", "", "  end"))
    got = [(c["first_line"], c["last_line"]) for c in one(spark, text, code.statement_chunks)]
    assert got[0][0] == 1 and got[-1][1] == 120
    assert all(b[0] == a[1] + 1 for a, b in zip(got, got[1:], strict=False)) and all(b - a < 40 for a, b in got)
    assert all(a % 4 == 1 for a, _ in got)  # chunks begin with statements
    assert [tuple(c) for c in one(spark, "x\n" + "  y\n" * 100, code.statement_chunks)] == [(1, 102)]
