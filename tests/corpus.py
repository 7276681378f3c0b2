"""A small source tree in memory, a file or two of each language, that the source-side queries run over whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from quarry.functions.pattern_tables import language_of

FILES = {
    "app/main.py": "import os\nimport app.util\nfrom app.store import save\n\n\n@app.get('/users/profile')\ndef show_profile():\n    return helper(1)\n\n\n@router.post('/ledger/{id}/forgotten-entry')\ndef add_entry():\n    return save(2)\n\n\ndef main():\n    show_profile()\n\n\nif __name__ == '__main__':\n    main()\n",
    "app/util.py": "def helper(v):\n    if v:\n        return clean(v)\n    return v\n\n\ndef clean(v):\n    return str(v)\n\n\ndef leftover(v):\n    return v\n\n\ndef _private(v):\n    return v\n",
    "app/store.py": "class Store(Base):\n    '''Keeps rows.'''\n\n    @property\n    def size(self):\n        return len(self.rows)\n\n    def visit_row(self, row):\n        return row\n\n    def unused_step(self, row):\n        for x in row:\n            self.rows.append(x)\n        return row\n\n\ndef save(x):\n    return Store().size\n",
    "app/broken.py": "class Half:\n    def f(:\n        pass\n",
    "tests/test_util.py": "from app.util import helper\n\n\ndef test_helper():\n    assert helper(1)\n",
    "web/page.ts": "import { paint } from './lib';\nexport class Widget {\n}\nexport function draw(x) {\n  return paint(x);\n}\nfetch('/users/profile');\nrouter.get('/reports/orphaned-view', draw);\n",
    "web/lib.ts": "export const paint = (x) => x;\ninterface Shape {\n}\n",
    "web/bundle.min.js": "var a=1;\n",
    "srv/main.go": 'package main\n\nimport "example.org/proj/srv/store"\n\ntype Server struct {\n}\n\nfunc (s *Server) Run() {\n}\n\nfunc main() {\n\thttp.HandleFunc("/health", run)\n}\n',
    "srv/store/db.go": "package store\n\ntype Rows interface {\n}\n\nfunc Open() {\n}\n",
    "src/lib.rs": "use crate::model::Item;\n\npub struct Index;\n\nimpl Search for Index {\n    fn find(&self) {}\n}\n\n#[test]\nfn works() {}\n",
    "src/model.rs": "pub enum Item { A }\n",
    "src/main/java/org/demo/App.java": "package org.demo;\nimport org.demo.Part;\nimport java.util.List;\nimport org.demo.*;\npublic class App {\n    public static void main(String[] args) {\n    }\n}\n",
    "src/main/java/org/demo/Part.java": "package org.demo;\npublic interface Part {\n}\n",
    "cs/Program.cs": "using System;\nusing Demo.Tools;\nnamespace Demo {\n    public class Program {\n        static void Main(string[] args) {\n        }\n    }\n}\n",
    "cs/lib/Tools.cs": "namespace Demo.Tools {\n    public enum Kind { A }\n}\n",
    "c/main.c": '#include "util.h"\n#include <stdio.h>\nint main(void) {\n    return 0;\n}\n',
    "c/util.h": "struct point {\n    int x;\n};\n",
    "php/index.php": "<?php\nuse App\\Models\\User;\nclass HomeController {\n    public function show() {\n    }\n}\nRoute::get('/home', 'show');\n",
    "app/Models/User.php": "<?php\nclass User {\n}\n",
    "rb/run.rb": "require_relative './tool'\nclass Job\n  def call!\n  end\nend\n",
    "rb/tool.rb": "module Tool\nend\n",
    "ios/App.swift": "import SwiftUI\n@main\nstruct Demo: App {\n    func body() {\n    }\n}\n",
    "zig/main.zig": 'const lib = @import("lib.zig");\npub fn main() void {\n}\ntest "adds" {\n}\n',
    "zig/lib.zig": "pub const Point = struct {\n};\n",
    "db/schema.sql": "CREATE TABLE users (\n  id bigint PRIMARY KEY,\n  name varchar(40) NOT NULL, -- shown\n  PRIMARY KEY (id)\n);\nCREATE VIEW names AS SELECT name FROM users;\n",
    "docs/guide.md": "# Guide\n\nSee [setup](setup.md).\n\n## Install\n\n```bash\n# not a heading\nrun\n```\n\n## Use\n\nWords.\n\nNotes\n-----\n\n# Appendix\nend\n",
    "docs/setup.md": "Setup\n=====\n\ntext\n",
    "docs/notes.txt": "INTRODUCTION\n\nfirst words\nmore words\n\nTitle\n=====\nbody runs on\n\nsecond part\n\nopen end\n",
    "style/main.css": "/* all */\n:root { --gap: 4px; }\n.a, .b {\n  color: red;\n  margin: var(--gap);\n}\n@media print {\n  p { color: black; }\n}\n@import 'base.css';\n",
    "style/base.css": "p { margin: 0; }\n",
    "style/_mix.scss": "$gap: 4px;\n@mixin wide($x) {\n}\n",
    "style/app.scss": "@use 'mix';\n.box {\n}\n",
    "templates/used.html": "<form action='/users/profile'><input><select></select></form>\n<ul><li>a</li><li>b</li></ul>\n<table><tr><th>a</th><th>b</th></tr><tr><td>1</td></tr></table>\n",
    "templates/dead.html": "<p>{% block body %}{% endblock %}</p>\n",
    "templates/base.html": "<body>{% include 'used.html' %}</body>\n",
    "package.json": '{\n  "main": "web/page.js",\n  "bin": {"draw": "web/draw.js"},\n  "scripts": {"build": "node tools/build.mjs --fast"}\n}\n',
    "tsconfig.json": '{\n  "extends": "./base.json",\n  "files": ["web/page.ts"],\n  "compilerOptions": {"paths": {"@/*": ["./web/*"]}}\n}\n',
    "docker-compose.yml": "services:\n  db:\n    env_file: .env.local\n    volumes:\n      - ./data:/var/data\n",
    "pyproject.toml": "[project.scripts]\nrun = 'app.main:main'\n[tool.mypy]\nconfig_file = 'mypy.ini'\n",
    "vendor/lib/x.py": "def vendored():\n    return 1\n",
    "node_modules/a.js": "function a() {}\n",
    "img.PNG": "",
}


def files(spark: SparkSession, names: Sequence[str] | None = None) -> DataFrame:
    """(path, content, language, size, mtime, is_binary); sizes are those of the texts, times of no meaning."""
    rows = [(p, c, len(c.encode()), float(86_400 * k)) for k, (p, c) in enumerate(sorted(FILES.items())) if names is None or p in names]
    return spark.createDataFrame(rows, "path string, content string, size long, mtime double").selectExpr("*", "false as is_binary", f"{language_of()} as language")
