"""Answers to the questions of ``corpus_queries``, checked by hand against the files of ``corpus``; columns are "name type"."""

from __future__ import annotations

EXPECTED: dict[str, tuple[str, list[tuple]]] = {
    "tree_languages": (
        "path VARCHAR, language VARCHAR, walk_skips BOOLEAN, analyze_skips BOOLEAN, scan_skips BOOLEAN, low_value BOOLEAN, is_source BOOLEAN, cluster VARCHAR",
        [
            ('app/Models/User.php', 'php', False, False, False, True, True, 'core_logic'),
            ('app/broken.py', 'python', False, False, False, True, True, 'other'),
            ('app/main.py', 'python', False, False, False, False, True, 'entry_points'),
            ('app/store.py', 'python', False, False, False, False, True, 'other'),
            ('app/util.py', 'python', False, False, False, False, True, 'other'),
            ('c/main.c', 'cpp', False, False, False, False, True, 'entry_points'),
            ('c/util.h', 'cpp', False, False, False, True, True, 'other'),
            ('cs/Program.cs', 'csharp', False, False, False, False, True, 'entry_points'),
            ('cs/lib/Tools.cs', 'csharp', False, False, False, False, True, 'other'),
            ('db/schema.sql', 'sql', False, False, False, False, True, 'schema'),
            ('docker-compose.yml', 'config', False, False, False, False, True, 'config'),
            ('docs/guide.md', 'markdown', False, False, False, False, True, 'documentation'),
            ('docs/notes.txt', 'text', False, False, False, False, True, 'other'),
            ('docs/setup.md', 'markdown', False, False, False, True, True, 'documentation'),
            ('img.PNG', 'image', False, False, False, False, True, 'other'),
            ('ios/App.swift', 'swift', False, False, False, False, True, 'entry_points'),
            ('node_modules/a.js', 'typescript', True, False, False, True, False, 'other'),
            ('package.json', 'config', False, False, False, False, True, 'config'),
            ('php/index.php', 'php', False, False, False, False, True, 'entry_points'),
            ('pyproject.toml', 'config', False, False, False, False, True, 'config'),
            ('rb/run.rb', 'ruby', False, False, False, False, True, 'other'),
            ('rb/tool.rb', 'ruby', False, False, False, True, True, 'other'),
            ('src/lib.rs', 'rust', False, False, False, False, True, 'entry_points'),
            ('src/main/java/org/demo/App.java', 'java', False, False, False, False, True, 'entry_points'),
            ('src/main/java/org/demo/Part.java', 'java', False, False, False, True, True, 'other'),
            ('src/model.rs', 'rust', False, False, False, True, True, 'other'),
            ('srv/main.go', 'go', False, False, False, False, True, 'entry_points'),
            ('srv/store/db.go', 'go', False, False, False, False, True, 'other'),
            ('style/_mix.scss', 'scss', False, False, False, True, True, 'utilities'),
            ('style/app.scss', 'scss', False, False, False, True, True, 'entry_points'),
            ('style/base.css', 'css', False, False, False, True, True, 'utilities'),
            ('style/main.css', 'css', False, False, False, False, True, 'entry_points'),
            ('templates/base.html', 'html', False, False, False, True, True, 'other'),
            ('templates/dead.html', 'html', False, False, False, True, True, 'other'),
            ('templates/used.html', 'html', False, False, False, False, True, 'other'),
            ('tests/test_util.py', 'python', False, False, False, False, False, 'tests'),
            ('tsconfig.json', 'config', False, False, False, False, True, 'config'),
            ('vendor/lib/x.py', 'python', True, False, False, True, False, 'other'),
            ('web/bundle.min.js', 'typescript', False, True, True, True, True, 'other'),
            ('web/lib.ts', 'typescript', False, False, False, False, True, 'other'),
            ('web/page.ts', 'typescript', False, False, False, False, True, 'other'),
            ('zig/lib.zig', 'zig', False, False, False, True, True, 'other'),
            ('zig/main.zig', 'zig', False, False, False, False, True, 'entry_points'),
        ],
    ),
    "default_exclusions": (
        "path VARCHAR, ignored BOOLEAN",
        [
            ('docs/notes.txt', True),
            ('docs/setup.md', True),
            ('node_modules/a.js', True),
        ],
    ),
    "glob_matches": (
        "glob VARCHAR, n BIGINT, first VARCHAR, last VARCHAR",
        [
            ('**/*', 43, 'app/Models/User.php', 'zig/main.zig'),
            ('**/*.py', 6, 'app/broken.py', 'vendor/lib/x.py'),
            ('**/*.ts', 2, 'web/lib.ts', 'web/page.ts'),
            ('**/main.?', 1, 'c/main.c', 'c/main.c'),
            ('**/org/*/*.java', 2, 'src/main/java/org/demo/App.java', 'src/main/java/org/demo/Part.java'),
            ('*.json', 2, 'package.json', 'tsconfig.json'),
            ('app/*', 5, 'app/Models/User.php', 'app/util.py'),
        ],
    ),
    "source_structures": (
        "path VARCHAR, language VARCHAR, line_no INTEGER, type VARCHAR, name VARCHAR",
        [
            ('app/Models/User.php', 'php', 2, 'class', 'User'),
            ('app/broken.py', 'python', 1, 'class', 'Half'),
            ('app/broken.py', 'python', 2, 'function', 'f'),
            ('app/main.py', 'python', 7, 'function', 'show_profile'),
            ('app/main.py', 'python', 12, 'function', 'add_entry'),
            ('app/main.py', 'python', 16, 'function', 'main'),
            ('app/store.py', 'python', 1, 'class', 'Store'),
            ('app/store.py', 'python', 5, 'function', 'size'),
            ('app/store.py', 'python', 8, 'function', 'visit_row'),
            ('app/store.py', 'python', 11, 'function', 'unused_step'),
            ('app/store.py', 'python', 17, 'function', 'save'),
            ('app/util.py', 'python', 1, 'function', 'helper'),
            ('app/util.py', 'python', 7, 'function', 'clean'),
            ('app/util.py', 'python', 11, 'function', 'leftover'),
            ('app/util.py', 'python', 15, 'function', '_private'),
            ('c/main.c', 'cpp', 3, 'function', 'main'),
            ('c/util.h', 'cpp', 1, 'struct', 'point'),
            ('cs/Program.cs', 'csharp', 3, 'namespace', 'Demo'),
            ('cs/Program.cs', 'csharp', 4, 'class', 'Program'),
            ('cs/Program.cs', 'csharp', 5, 'method', 'Main'),
            ('cs/lib/Tools.cs', 'csharp', 1, 'namespace', 'Demo.Tools'),
            ('cs/lib/Tools.cs', 'csharp', 2, 'enum', 'Kind'),
            ('db/schema.sql', 'sql', 1, 'table', 'users'),
            ('db/schema.sql', 'sql', 6, 'view', 'names'),
            ('docs/guide.md', 'markdown', 1, 'heading-1', 'Guide'),
            ('docs/guide.md', 'markdown', 5, 'heading-2', 'Install'),
            ('docs/guide.md', 'markdown', 8, 'heading-1', 'not a heading'),
            ('docs/guide.md', 'markdown', 12, 'heading-2', 'Use'),
            ('docs/guide.md', 'markdown', 19, 'heading-1', 'Appendix'),
            ('ios/App.swift', 'swift', 3, 'struct', 'Demo'),
            ('ios/App.swift', 'swift', 4, 'function', 'body'),
            ('node_modules/a.js', 'typescript', 1, 'function', 'a'),
            ('php/index.php', 'php', 3, 'class', 'HomeController'),
            ('php/index.php', 'php', 4, 'function', 'show'),
            ('rb/run.rb', 'ruby', 2, 'class', 'Job'),
            ('rb/run.rb', 'ruby', 3, 'method', 'call!'),
            ('rb/tool.rb', 'ruby', 1, 'module', 'Tool'),
            ('src/lib.rs', 'rust', 3, 'struct', 'Index'),
            ('src/lib.rs', 'rust', 5, 'impl', 'Search for Index'),
            ('src/lib.rs', 'rust', 6, 'function', 'find'),
            ('src/lib.rs', 'rust', 10, 'function', 'works'),
            ('src/main/java/org/demo/App.java', 'java', 5, 'class', 'App'),
            ('src/main/java/org/demo/App.java', 'java', 6, 'method', 'main'),
            ('src/main/java/org/demo/Part.java', 'java', 2, 'interface', 'Part'),
            ('src/model.rs', 'rust', 1, 'enum', 'Item'),
            ('srv/main.go', 'go', 5, 'struct', 'Server'),
            ('srv/main.go', 'go', 8, 'method', 'Run'),
            ('srv/main.go', 'go', 11, 'function', 'main'),
            ('srv/store/db.go', 'go', 3, 'interface', 'Rows'),
            ('srv/store/db.go', 'go', 6, 'function', 'Open'),
            ('style/_mix.scss', 'scss', 1, 'variable', '$gap'),
            ('style/_mix.scss', 'scss', 2, 'mixin', 'wide'),
            ('style/app.scss', 'scss', 2, 'rule', '.box'),
            ('style/base.css', 'css', 1, 'rule', 'p'),
            ('style/main.css', 'css', 3, 'rule', '.a, .b'),
            ('style/main.css', 'css', 7, 'media', 'print'),
            ('style/main.css', 'css', 8, 'rule', 'p'),
            ('tests/test_util.py', 'python', 4, 'function', 'test_helper'),
            ('vendor/lib/x.py', 'python', 1, 'function', 'vendored'),
            ('web/lib.ts', 'typescript', 1, 'function', 'paint'),
            ('web/lib.ts', 'typescript', 2, 'interface', 'Shape'),
            ('web/page.ts', 'typescript', 2, 'class', 'Widget'),
            ('web/page.ts', 'typescript', 4, 'function', 'draw'),
            ('zig/lib.zig', 'zig', 1, 'struct', 'Point'),
            ('zig/main.zig', 'zig', 2, 'function', 'main'),
            ('zig/main.zig', 'zig', 4, 'test', 'adds'),
        ],
    ),
    "source_imports": (
        "path VARCHAR, language VARCHAR, line_no INTEGER, type VARCHAR, name VARCHAR",
        [
            ('app/main.py', 'python', 1, 'import', 'os'),
            ('app/main.py', 'python', 2, 'import', 'app.util'),
            ('app/main.py', 'python', 3, 'from', 'app.store'),
            ('c/main.c', 'cpp', 1, 'quoted', 'util.h'),
            ('c/main.c', 'cpp', 2, 'angle', 'stdio.h'),
            ('cs/Program.cs', 'csharp', 1, 'using', 'System'),
            ('cs/Program.cs', 'csharp', 2, 'using', 'Demo.Tools'),
            ('docs/guide.md', 'markdown', 3, 'link', 'setup.md'),
            ('ios/App.swift', 'swift', 1, 'import', 'SwiftUI'),
            ('php/index.php', 'php', 2, 'use', 'App\\Models\\User'),
            ('rb/run.rb', 'ruby', 1, 'require_relative', './tool'),
            ('src/main/java/org/demo/App.java', 'java', 2, 'import', 'org.demo.Part'),
            ('src/main/java/org/demo/App.java', 'java', 3, 'import', 'java.util.List'),
            ('src/main/java/org/demo/App.java', 'java', 4, 'import', 'org.demo.*'),
            ('srv/main.go', 'go', 3, 'import', 'example.org/proj/srv/store'),
            ('style/app.scss', 'scss', 1, 'use', 'mix'),
            ('style/main.css', 'css', 10, 'import', 'base.css'),
            ('tests/test_util.py', 'python', 1, 'from', 'app.util'),
            ('web/page.ts', 'typescript', 1, 'import', './lib'),
            ('zig/main.zig', 'zig', 1, 'import', 'lib.zig'),
        ],
    ),
    "source_entry_points": (
        "path VARCHAR, type VARCHAR, name VARCHAR, line INTEGER, label VARCHAR",
        [
            ('app/main.py', 'if_main', '__name__', 20, 'if __name__ @20'),
            ('app/main.py', 'main_function', 'main', 16, 'main() @16'),
            ('c/main.c', 'main_function', 'main', 3, 'main @3'),
            ('cs/Program.cs', 'main_function', 'Main', 5, 'Main @5'),
            ('docker-compose.yml', 'project_config', 'docker_compose_project', 1, 'docker_compose_project @1'),
            ('docker-compose.yml', 'services_section', 'services', 1, 'services @1'),
            ('ios/App.swift', 'app', 'Demo', 3, 'Demo @3'),
            ('ios/App.swift', 'main_type', 'Demo', 2, 'Demo @2'),
            ('package.json', 'bin_script', 'draw', 3, 'draw @3'),
            ('package.json', 'main_entry', 'web/page.js', 2, 'web/page.js @2'),
            ('package.json', 'project_config', 'npm_project', 1, 'npm_project @1'),
            ('php/index.php', 'controller', 'HomeController', 3, 'HomeController @3'),
            ('php/index.php', 'route', '/home', 7, '/home @7'),
            ('pyproject.toml', 'project_config', 'python_project', 1, 'python_project @1'),
            ('pyproject.toml', 'scripts_section', 'project_scripts', 1, 'project_scripts @1'),
            ('src/lib.rs', 'test', 'works', 9, 'works @9'),
            ('src/main/java/org/demo/App.java', 'main_function', 'main', 6, 'public static void main @6'),
            ('srv/main.go', 'http_handler', '/health', 12, '/health @12'),
            ('srv/main.go', 'main_function', 'main', 11, 'func main() @11'),
            ('style/main.css', 'variables', ':root', 2, ':root @2'),
            ('tsconfig.json', 'project_config', 'typescript_project', 1, 'typescript_project @1'),
            ('zig/main.zig', 'main_function', 'main', 2, 'main @2'),
            ('zig/main.zig', 'test', 'adds', 4, 'adds @4'),
        ],
    ),
    "source_calls": (
        "caller_file VARCHAR, caller_name VARCHAR, callee_name VARCHAR, line INTEGER, is_cross_file BOOLEAN",
        [
            ('c/main.c', None, 'main', 3, False),
            ('cs/Program.cs', None, 'Main', 5, False),
            ('ios/App.swift', None, 'body', 4, False),
            ('node_modules/a.js', None, 'a', 1, False),
            ('php/index.php', None, 'get', 7, True),
            ('php/index.php', None, 'show', 4, False),
            ('src/lib.rs', None, 'find', 6, False),
            ('src/lib.rs', None, 'works', 10, False),
            ('src/main/java/org/demo/App.java', None, 'main', 6, False),
            ('srv/main.go', None, 'HandleFunc', 12, True),
            ('srv/main.go', None, 'Run', 8, False),
            ('srv/main.go', None, 'main', 11, False),
            ('srv/store/db.go', None, 'Open', 6, False),
            ('tests/test_util.py', None, 'helper', 5, True),
            ('tests/test_util.py', None, 'test_helper', 4, False),
            ('vendor/lib/x.py', None, 'vendored', 1, False),
            ('web/page.ts', None, 'draw', 4, False),
            ('web/page.ts', None, 'fetch', 7, True),
            ('web/page.ts', None, 'get', 8, True),
            ('web/page.ts', None, 'paint', 5, True),
            ('zig/main.zig', None, 'import', 1, True),
            ('zig/main.zig', None, 'main', 2, False),
        ],
    ),
    "source_definitions": (
        "file VARCHAR, type VARCHAR, name VARCHAR, line INTEGER",
        [
            ('app/Models/User.php', 'class', 'User', 2),
            ('c/main.c', 'function', 'main', 3),
            ('cs/Program.cs', 'class', 'Program', 4),
            ('cs/Program.cs', 'method', 'Main', 5),
            ('ios/App.swift', 'function', 'body', 4),
            ('node_modules/a.js', 'function', 'a', 1),
            ('php/index.php', 'class', 'HomeController', 3),
            ('php/index.php', 'function', 'show', 4),
            ('rb/run.rb', 'class', 'Job', 2),
            ('rb/run.rb', 'method', 'call!', 3),
            ('src/lib.rs', 'function', 'find', 6),
            ('src/lib.rs', 'function', 'works', 10),
            ('src/main/java/org/demo/App.java', 'class', 'App', 5),
            ('src/main/java/org/demo/App.java', 'method', 'main', 6),
            ('srv/main.go', 'function', 'main', 11),
            ('srv/main.go', 'method', 'Run', 8),
            ('srv/store/db.go', 'function', 'Open', 6),
            ('web/lib.ts', 'function', 'paint', 1),
            ('web/page.ts', 'class', 'Widget', 2),
            ('web/page.ts', 'function', 'draw', 4),
            ('zig/main.zig', 'function', 'main', 2),
        ],
    ),
    "source_import_edges": (
        "src VARCHAR, dst VARCHAR",
        [
            ('app/main.py', 'app/store.py'),
            ('app/main.py', 'app/util.py'),
            ('c/main.c', 'c/util.h'),
            ('cs/Program.cs', 'cs/lib/Tools.cs'),
            ('docs/guide.md', 'docs/setup.md'),
            ('ios/App.swift', 'src/main/java/org/demo/App.java'),
            ('php/index.php', 'app/Models/User.php'),
            ('rb/run.rb', 'rb/tool.rb'),
            ('src/lib.rs', 'src/model.rs'),
            ('src/main/java/org/demo/App.java', 'src/main/java/org/demo/Part.java'),
            ('srv/main.go', 'srv/store/db.go'),
            ('style/app.scss', 'style/_mix.scss'),
            ('style/main.css', 'style/base.css'),
            ('tests/test_util.py', 'app/util.py'),
            ('tsconfig.json', 'web/page.ts'),
            ('web/page.ts', 'web/lib.ts'),
            ('zig/main.zig', 'zig/lib.zig'),
        ],
    ),
    "config_references": (
        "path VARCHAR, name VARCHAR, line INTEGER, type VARCHAR",
        [
            ('docker-compose.yml', './data', 5, 'volume_mount'),
            ('docker-compose.yml', '.env.local', 3, 'env_file'),
            ('package.json', 'tools/build.mjs', 4, 'script_file'),
            ('pyproject.toml', 'mypy.ini', 4, 'config_file'),
            ('tsconfig.json', './base.json', 2, 'extends'),
            ('tsconfig.json', './base.json', 2, 'path_reference'),
            ('tsconfig.json', './web/*', 4, 'path_mapping'),
            ('tsconfig.json', 'web/page.ts', 3, 'file_reference'),
        ],
    ),
    "config_entry_points": (
        "path VARCHAR, type VARCHAR, name VARCHAR, line INTEGER, framework VARCHAR",
        [
            ('docker-compose.yml', 'project_config', 'docker_compose_project', 1, 'Docker'),
            ('docker-compose.yml', 'services_section', 'services', 1, 'Docker'),
            ('package.json', 'bin_script', 'draw', 3, 'npm'),
            ('package.json', 'main_entry', 'web/page.js', 2, 'npm'),
            ('package.json', 'project_config', 'npm_project', 1, 'npm'),
            ('pyproject.toml', 'project_config', 'python_project', 1, 'Python'),
            ('pyproject.toml', 'scripts_section', 'project_scripts', 1, 'Python'),
            ('tsconfig.json', 'project_config', 'typescript_project', 1, 'TypeScript'),
        ],
    ),
    "sql_table_columns": (
        "path VARCHAR, table_name VARCHAR, name VARCHAR, type VARCHAR, line INTEGER",
        [
            ('db/schema.sql', 'users', 'id', 'bigint', 2),
            ('db/schema.sql', 'users', 'name', 'varchar(40)', 3),
        ],
    ),
    "css_rule_counts": (
        "path VARCHAR, name VARCHAR, selectors INTEGER, declarations INTEGER, has_variables BOOLEAN",
        [
            ('style/base.css', 'p', 1, 1, False),
            ('style/main.css', '.a (+1)', 2, 2, False),
            ('style/main.css', ':root', 1, 1, True),
            ('style/main.css', 'p', 1, 1, False),
        ],
    ),
    "html_element_counts": (
        "path VARCHAR, at INTEGER, type VARCHAR, n INTEGER, width INTEGER",
        [
            ('templates/used.html', 0, 'form', 2, None),
            ('templates/used.html', 0, 'list', 2, None),
            ('templates/used.html', 0, 'table', 2, 2),
        ],
    ),
    "parsed_nodes": (
        "path VARCHAR, node_id INTEGER, parent_id INTEGER, last_desc_id INTEGER, depth INTEGER, type VARCHAR, name VARCHAR, start_line INTEGER, end_line INTEGER, signature VARCHAR, decorators VARCHAR, docstring VARCHAR, lines INTEGER, branches INTEGER, tier VARCHAR",
        [
            ('app/Models/User.php', 0, -1, 0, 0, 'class', 'User', 2, 3, '', '', None, 2, None, 'tokens'),
            ('app/broken.py', 0, -1, 0, 0, 'class', 'Half (fallback)', 1, 1, None, '', None, None, None, 'pattern'),
            ('app/broken.py', 1, -1, 1, 0, 'function', 'f (fallback)', 2, 2, None, '', None, None, None, 'pattern'),
            ('app/main.py', 0, -1, 0, 0, 'imports', 'imports', 1, 3, None, '', None, None, None, 'syntax'),
            ('app/main.py', 1, -1, 1, 0, 'function', 'show_profile', 7, 8, '()', "@app.get('/users/profile')", None, 2, 0, 'syntax'),
            ('app/main.py', 2, -1, 2, 0, 'function', 'add_entry', 12, 13, '()', "@router.post('/ledger/{id}/forgotten-entry')", None, 2, 0, 'syntax'),
            ('app/main.py', 3, -1, 3, 0, 'function', 'main', 16, 17, '()', '', None, 2, 0, 'syntax'),
            ('app/store.py', 0, -1, 3, 0, 'class', 'Store', 1, 14, '(Base)', '', 'Keeps rows.', 14, 1, 'syntax'),
            ('app/store.py', 1, 0, 1, 1, 'method', 'size', 5, 6, '(self)', '@property', None, 2, 0, 'syntax'),
            ('app/store.py', 2, 0, 2, 1, 'method', 'visit_row', 8, 9, '(self, row)', '', None, 2, 0, 'syntax'),
            ('app/store.py', 3, 0, 3, 1, 'method', 'unused_step', 11, 14, '(self, row)', '', None, 4, 1, 'syntax'),
            ('app/store.py', 4, -1, 4, 0, 'function', 'save', 17, 18, '(x)', '', None, 2, 0, 'syntax'),
            ('app/util.py', 0, -1, 0, 0, 'function', 'helper', 1, 4, '(v)', '', None, 4, 1, 'syntax'),
            ('app/util.py', 1, -1, 1, 0, 'function', 'clean', 7, 8, '(v)', '', None, 2, 0, 'syntax'),
            ('app/util.py', 2, -1, 2, 0, 'function', 'leftover', 11, 12, '(v)', '', None, 2, 0, 'syntax'),
            ('app/util.py', 3, -1, 3, 0, 'function', '_private', 15, 16, '(v)', '', None, 2, 0, 'syntax'),
            ('c/main.c', 0, -1, 0, 0, 'function', 'main', 3, 5, '(void) : int', '', None, 3, None, 'tokens'),
            ('c/util.h', 0, -1, 0, 0, 'struct', 'point', 1, 3, '', '', None, 3, None, 'tokens'),
            ('cs/Program.cs', 0, -1, 2, 0, 'namespace', 'Demo', 3, 8, '', '', None, 6, None, 'tokens'),
            ('cs/Program.cs', 1, 0, 2, 1, 'class', 'Program', 4, 7, '', '', None, 4, None, 'tokens'),
            ('cs/Program.cs', 2, 1, 2, 2, 'method', 'Main', 5, 6, '(string[] args) : void', '', None, 2, None, 'tokens'),
            ('cs/lib/Tools.cs', 0, -1, 1, 0, 'namespace', 'Demo.Tools', 1, 3, '', '', None, 3, None, 'tokens'),
            ('cs/lib/Tools.cs', 1, 0, 1, 1, 'enum', 'Kind', 2, 2, '', '', None, 1, None, 'tokens'),
            ('db/schema.sql', 0, -1, 0, 0, 'table', 'users', 1, 5, 'id bigint, name varchar(40)', '', None, None, None, 'statements'),
            ('db/schema.sql', 1, -1, 1, 0, 'view', 'names', 6, 6, '', '', None, None, None, 'statements'),
            ('docs/guide.md', 0, -1, 4, 0, 'heading-1', 'Guide', 1, 18, None, '', None, None, None, 'lines'),
            ('docs/guide.md', 1, 0, 2, 1, 'heading-2', 'Install', 5, 10, None, '', None, None, None, 'lines'),
            ('docs/guide.md', 2, 1, 2, 1, 'code-block', 'code block (bash)', 7, 10, None, '', None, None, None, 'lines'),
            ('docs/guide.md', 3, 0, 3, 1, 'heading-2', 'Use', 12, 15, None, '', None, None, None, 'lines'),
            ('docs/guide.md', 4, 0, 4, 1, 'heading-2', 'Notes', 16, 18, None, '', None, None, None, 'lines'),
            ('docs/guide.md', 5, -1, 5, 0, 'heading-1', 'Appendix', 19, 21, None, '', None, None, None, 'lines'),
            ('docs/notes.txt', 0, -1, 1, 0, 'section', 'INTRODUCTION', 1, 5, None, '', None, None, None, 'lines'),
            ('docs/notes.txt', 1, 0, 1, 1, 'paragraph', 'paragraph (3-4)', 3, 4, None, '', None, None, None, 'lines'),
            ('docs/notes.txt', 2, -1, 5, 0, 'section', 'Title', 6, 13, None, '', None, None, None, 'lines'),
            ('docs/notes.txt', 3, 2, 3, 1, 'paragraph', 'paragraph (8-8)', 8, 8, None, '', None, None, None, 'lines'),
            ('docs/notes.txt', 4, 2, 4, 1, 'paragraph', 'paragraph (10-10)', 10, 10, None, '', None, None, None, 'lines'),
            ('docs/notes.txt', 5, 2, 5, 1, 'paragraph', 'paragraph (12-12)', 12, 12, None, '', None, None, None, 'lines'),
            ('docs/setup.md', 0, -1, 0, 0, 'heading-1', 'Setup', 1, 5, None, '', None, None, None, 'lines'),
            ('ios/App.swift', 0, -1, 1, 0, 'struct', 'Demo', 3, 6, ': App', '', None, 4, None, 'tokens'),
            ('ios/App.swift', 1, 0, 1, 1, 'method', 'body', 4, 5, '()', '', None, 2, None, 'tokens'),
            ('node_modules/a.js', 0, -1, 0, 0, 'function', 'a', 1, 1, '()', '', None, 1, None, 'tokens'),
            ('php/index.php', 0, -1, 1, 0, 'class', 'HomeController', 3, 6, '', '', None, 4, None, 'tokens'),
            ('php/index.php', 1, 0, 1, 1, 'method', 'show', 4, 5, '()', '', None, 2, None, 'tokens'),
            ('src/lib.rs', 0, -1, 0, 0, 'struct', 'Index', 3, 3, '', '', None, 1, None, 'tokens'),
            ('src/lib.rs', 1, -1, 2, 0, 'impl', 'Search for Index', 5, 7, '', '', None, 3, None, 'tokens'),
            ('src/lib.rs', 2, 1, 2, 1, 'function', 'find', 6, 6, '(&self)', '', None, 1, None, 'tokens'),
            ('src/lib.rs', 3, -1, 3, 0, 'function', 'works', 10, 10, '()', '#[test]', None, 1, None, 'tokens'),
            ('src/main/java/org/demo/App.java', 0, -1, 1, 0, 'class', 'App', 5, 8, '', '', None, 4, None, 'tokens'),
            ('src/main/java/org/demo/App.java', 1, 0, 1, 1, 'method', 'main', 6, 7, '(String[] args) : void', '', None, 2, None, 'tokens'),
            ('src/main/java/org/demo/Part.java', 0, -1, 0, 0, 'interface', 'Part', 2, 3, '', '', None, 2, None, 'tokens'),
            ('src/model.rs', 0, -1, 0, 0, 'enum', 'Item', 1, 1, '', '', None, 1, None, 'tokens'),
            ('srv/main.go', 0, -1, 0, 0, 'struct', 'Server', 5, 6, '', '', None, 2, None, 'tokens'),
            ('srv/main.go', 1, -1, 1, 0, 'method', 'Run', 8, 9, '(s *Server) ()', '', None, 2, None, 'tokens'),
            ('srv/main.go', 2, -1, 2, 0, 'function', 'main', 11, 13, '()', '', None, 3, None, 'tokens'),
            ('srv/store/db.go', 0, -1, 0, 0, 'interface', 'Rows', 3, 4, '', '', None, 2, None, 'tokens'),
            ('srv/store/db.go', 1, -1, 1, 0, 'function', 'Open', 6, 7, '()', '', None, 2, None, 'tokens'),
            ('templates/used.html', 0, -1, 0, 0, 'form', 'form', 1, 1, None, '', None, None, None, 'markup'),
            ('templates/used.html', 1, -1, 1, 0, 'list', 'ul', 2, 2, None, '', None, None, None, 'markup'),
            ('templates/used.html', 2, -1, 2, 0, 'table', 'table', 3, 3, None, '', None, None, None, 'markup'),
            ('tests/test_util.py', 0, -1, 0, 0, 'imports', 'imports', 1, 1, None, '', None, None, None, 'syntax'),
            ('tests/test_util.py', 1, -1, 1, 0, 'function', 'test_helper', 4, 5, '()', '', None, 2, 0, 'syntax'),
            ('vendor/lib/x.py', 0, -1, 0, 0, 'function', 'vendored', 1, 2, '()', '', None, 2, 0, 'syntax'),
            ('web/lib.ts', 0, -1, 0, 0, 'function', 'paint', 1, 1, '(x)', '', None, 1, None, 'tokens'),
            ('web/lib.ts', 1, -1, 1, 0, 'interface', 'Shape', 2, 3, '', '', None, 2, None, 'tokens'),
            ('web/page.ts', 0, -1, 0, 0, 'class', 'Widget', 2, 3, '', '', None, 2, None, 'tokens'),
            ('web/page.ts', 1, -1, 1, 0, 'function', 'draw', 4, 6, '(x)', '', None, 3, None, 'tokens'),
            ('zig/lib.zig', 0, -1, 0, 0, 'struct', 'Point', 1, 2, '', '', None, 2, None, 'tokens'),
            ('zig/main.zig', 0, -1, 0, 0, 'function', 'main', 2, 3, '() void', '', None, 2, None, 'tokens'),
            ('zig/main.zig', 1, -1, 1, 0, 'test', 'adds', 4, 5, '', '', None, 2, None, 'tokens'),
        ],
    ),
    "heading_tree": (
        "path VARCHAR, node_id INTEGER, parent_id INTEGER, last_desc_id INTEGER, type VARCHAR, name VARCHAR, start_line BIGINT, end_line BIGINT",
        [
            ('docs/guide.md', 0, -1, 4, 'heading-1', 'Guide', 1, 18),
            ('docs/guide.md', 1, 0, 2, 'heading-2', 'Install', 5, 10),
            ('docs/guide.md', 2, 1, 2, 'code-block', 'code block (bash)', 7, 10),
            ('docs/guide.md', 3, 0, 3, 'heading-2', 'Use', 12, 15),
            ('docs/guide.md', 4, 0, 4, 'heading-2', 'Notes', 16, 18),
            ('docs/guide.md', 5, -1, 5, 'heading-1', 'Appendix', 19, 21),
            ('docs/setup.md', 0, -1, 0, 'heading-1', 'Setup', 1, 5),
        ],
    ),
    "text_outline": (
        "path VARCHAR, type VARCHAR, name VARCHAR, start_line BIGINT, end_line BIGINT, section_line BIGINT",
        [
            ('docs/notes.txt', 'paragraph', 'paragraph (10-10)', 10, 10, 6),
            ('docs/notes.txt', 'paragraph', 'paragraph (12-12)', 12, 12, 6),
            ('docs/notes.txt', 'paragraph', 'paragraph (3-4)', 3, 4, 1),
            ('docs/notes.txt', 'paragraph', 'paragraph (8-8)', 8, 8, 6),
            ('docs/notes.txt', 'section', 'INTRODUCTION', 1, 5, None),
            ('docs/notes.txt', 'section', 'Title', 6, 13, None),
        ],
    ),
    "node_definitions": (
        "file VARCHAR, type VARCHAR, name VARCHAR, line INTEGER, signature VARCHAR, parent VARCHAR, enclosing_kind VARCHAR",
        [
            ('app/main.py', 'function', 'add_entry', 12, '()', None, None),
            ('app/main.py', 'function', 'main', 16, '()', None, None),
            ('app/main.py', 'function', 'show_profile', 7, '()', None, None),
            ('app/store.py', 'class', 'Store', 1, '(Base)', None, None),
            ('app/store.py', 'function', 'save', 17, '(x)', None, None),
            ('app/store.py', 'method', 'size', 5, '(self)', 'Store', 'class'),
            ('app/store.py', 'method', 'unused_step', 11, '(self, row)', 'Store', 'class'),
            ('app/store.py', 'method', 'visit_row', 8, '(self, row)', 'Store', 'class'),
            ('app/util.py', 'function', '_private', 15, '(v)', None, None),
            ('app/util.py', 'function', 'clean', 7, '(v)', None, None),
            ('app/util.py', 'function', 'helper', 1, '(v)', None, None),
            ('app/util.py', 'function', 'leftover', 11, '(v)', None, None),
        ],
    ),
    "node_candidates": (
        "path VARCHAR, name VARCHAR",
        [
            ('app/main.py', 'add_entry'),
            ('app/main.py', 'main'),
            ('app/main.py', 'show_profile'),
            ('app/store.py', 'save'),
            ('app/store.py', 'size'),
            ('app/store.py', 'unused_step'),
            ('app/store.py', 'visit_row'),
            ('app/util.py', '_private'),
            ('app/util.py', 'clean'),
            ('app/util.py', 'helper'),
            ('app/util.py', 'leftover'),
            ('tests/test_util.py', 'test_helper'),
            ('vendor/lib/x.py', 'vendored'),
        ],
    ),
    "structure_filters": (
        "filter VARCHAR, path VARCHAR, name VARCHAR",
        [
            ('complexity', 'rb/run.rb', 'call!'),
            ('decorator', 'app/main.py', 'add_entry'),
            ('name', 'app/main.py', 'show_profile'),
            ('name', 'app/store.py', 'save'),
            ('name', 'app/store.py', 'size'),
            ('type', 'app/store.py', 'size'),
            ('type', 'app/store.py', 'unused_step'),
            ('type', 'app/store.py', 'visit_row'),
            ('type', 'cs/Program.cs', 'Main'),
            ('type', 'ios/App.swift', 'body'),
            ('type', 'php/index.php', 'show'),
            ('type', 'rb/run.rb', 'call!'),
            ('type', 'src/main/java/org/demo/App.java', 'main'),
            ('type', 'srv/main.go', 'Run'),
        ],
    ),
    "focus_view": (
        "node_id INTEGER, part INTEGER, line VARCHAR",
        [
            (-1, 0, 'focus s is ambiguous (5 matches): use a qualified path'),
            (-1, 0, 'focus: Store.size @5-6'),
            (-1, 1, '  Store @1'),
            (-1, 2, '  Store.size @5'),
            (-1, 3, '  Store.visit_row @8'),
            (-1, 4, '  Store.unused_step @11'),
            (-1, 5, '  save @17'),
            (0, 0, '- Store (Base) @1 D8 # Keeps rows.'),
            (1, 0, '  5 |     def size(self):'),
            (1, 1, '  6 |         return len(self.rows)'),
            (2, 0, '  - visit_row (self, row) @8'),
            (3, 0, '  - unused_step (self, row) @11 D7'),
            (4, 0, '- save (x) @17'),
        ],
    ),
    "node_key_changes": (
        "path VARCHAR, node_key VARCHAR, status VARCHAR, changed BIGINT, unchanged BIGINT, removed VARCHAR",
        [
            ('app/store.py', '/class:Store', 'unchanged', 0, 5, ''),
            ('app/store.py', '/class:Store/method:size', 'unchanged', 0, 5, ''),
            ('app/store.py', '/class:Store/method:unused_step', 'unchanged', 0, 5, ''),
            ('app/store.py', '/class:Store/method:visit_row', 'unchanged', 0, 5, ''),
            ('app/store.py', '/function:save', 'unchanged', 0, 5, ''),
            ('app/util.py', '/function:_private', 'unchanged', 2, 2, 'leftover'),
            ('app/util.py', '/function:clean', 'changed', 2, 2, 'leftover'),
            ('app/util.py', '/function:helper', 'unchanged', 2, 2, 'leftover'),
            ('app/util.py', '/function:leftover', 'removed', 2, 2, 'leftover'),
            ('app/util.py', '/function:renamed', 'new', 2, 2, 'leftover'),
        ],
    ),
    "delta_view": (
        "node_key VARCHAR, status VARCHAR, skeleton VARCHAR",
        [
            ('/function:a', 'unchanged', None),
            ('/function:b', 'changed', 'y'),
            ('/function:c', None, 'z'),
        ],
    ),
    "tree_view": (
        "path VARCHAR, node_id INTEGER, part INTEGER, line VARCHAR",
        [
            ('app/store.py', 0, 0, '- Store (Base) @1 D8 # Keeps rows.'),
            ('app/store.py', 1, 0, '  - size (self) @5'),
            ('app/store.py', 1, 1, '     @property'),
            ('app/store.py', 1, 2, '     return len(self.rows)'),
            ('app/store.py', 2, 0, '  - visit_row (self, row) @8'),
            ('app/store.py', 2, 1, '     return row'),
            ('app/store.py', 3, 0, '  - unused_step (self, row) @11 D7'),
            ('app/store.py', 3, 1, '     for x in row:'),
            ('app/store.py', 3, 2, '      self.rows.append(x)'),
            ('app/store.py', 3, 3, '     return row'),
            ('app/store.py', 4, 0, '- save (x) @17'),
            ('app/store.py', 4, 1, '   return Store().size'),
            ('docs/guide.md', 0, 0, '- Guide @1'),
            ('docs/guide.md', 1, 0, '  - Install @5'),
            ('docs/guide.md', 2, 0, '  - code block (bash) @7'),
            ('docs/guide.md', 3, 0, '  - Use @12'),
            ('docs/guide.md', 4, 0, '  - Notes @16'),
            ('docs/guide.md', 5, 0, '- Appendix @19'),
        ],
    ),
    "tree_view_within_budget": (
        "node_id INTEGER, part INTEGER, line VARCHAR",
        [
            (0, 0, '- Store (Base) @1 D8 # Keeps rows.'),
            (1, 0, '  - size (self) @5'),
            (1, 1, '     @property'),
            (2, 0, '  - visit_row (self, row) @8'),
            (3, 0, '  - unused_step (self, row) @11 D7'),
            (3, 1, '     for x in row:'),
            (3, 2, '      …'),
            (3, 3, '     return row'),
            (4, 0, '- save (x) @17'),
            (4, 1, '   return Store().size'),
        ],
    ),
    "directory_lines": (
        "path VARCHAR, part INTEGER, line VARCHAR",
        [
            ('app/store.py', 0, 'Store, save'),
            ('app/store.py', 1, '> unused_step: for x in row: ; self.rows.append(x) ; return row'),
            ('app/util.py', 0, 'helper, clean, leftover, _private'),
            ('app/util.py', 1, '> helper: if v: ; return clean(v) ; return v'),
            ('web/page.ts', 0, 'Widget, draw'),
            ('web/page.ts', 1, '> draw: return paint(x);'),
        ],
    ),
    "nested_view": (
        "path VARCHAR, node_id INTEGER, line VARCHAR",
        [
            ('app/store.py', 0, '  class: Store (Base) (1-14)'),
            ('app/store.py', 1, '    method: size (self) (5-6)'),
            ('app/store.py', 2, '    method: visit_row (self, row) (8-9)'),
            ('app/store.py', 3, '    method: unused_step (self, row) (11-14)'),
            ('app/store.py', 4, '  function: save (x) (17-18)'),
            ('srv/main.go', 0, '  struct: Server (5-6)'),
            ('srv/main.go', 1, '  method: Run (s *Server) () (8-9)'),
            ('srv/main.go', 2, '  function: main () (11-13)'),
        ],
    ),
    "folded_lines": (
        "path VARCHAR, line_no BIGINT, text VARCHAR",
        [
            ('srv/main.go', 1, '…'),
            ('srv/main.go', 5, 'type Server struct {'),
            ('srv/main.go', 8, 'func (s *Server) Run() {'),
            ('srv/main.go', 11, 'func main() {'),
            ('srv/main.go', 12, '\thttp.HandleFunc("/health", run)'),
            ('web/page.ts', 1, '…'),
            ('web/page.ts', 2, 'export class Widget {'),
            ('web/page.ts', 4, 'export function draw(x) {'),
            ('web/page.ts', 5, '  return paint(x);'),
            ('web/page.ts', 7, "fetch('/users/profile');"),
            ('web/page.ts', 8, "router.get('/reports/orphaned-view', draw);"),
        ],
    ),
    "comment_folds": (
        "line_no INTEGER, text VARCHAR",
        [
            (1, '…'),
            (4, 'p {'),
            (5, '  …'),
            (6, '  color: red;'),
            (8, '…'),
            (9, 'q'),
        ],
    ),
    "structure_totals": (
        "dir VARCHAR, files BIGINT, classes BIGINT, functions BIGINT, methods BIGINT, label VARCHAR",
        [
            ('', 5, 0, 0, 0, '(5 files)'),
            ('app', 4, 2, 9, 3, '(4 files, 2 classes, 9 functions, 3 methods)'),
            ('app/Models', 1, 1, 0, 0, '(1 file, 1 class)'),
            ('c', 2, 0, 1, 0, '(2 files, 1 function)'),
            ('cs', 1, 1, 0, 1, '(1 file, 1 class, 1 method)'),
            ('cs/lib', 1, 0, 0, 0, '(1 file)'),
            ('db', 1, 0, 0, 0, '(1 file)'),
            ('docs', 3, 0, 0, 0, '(3 files)'),
            ('ios', 1, 0, 0, 1, '(1 file, 1 method)'),
            ('node_modules', 1, 0, 1, 0, '(1 file, 1 function)'),
            ('php', 1, 1, 0, 1, '(1 file, 1 class, 1 method)'),
            ('rb', 2, 1, 0, 1, '(2 files, 1 class, 1 method)'),
            ('src', 2, 0, 2, 0, '(2 files, 2 functions)'),
            ('src/main/java/org/demo', 2, 1, 0, 1, '(2 files, 1 class, 1 method)'),
            ('srv', 1, 0, 1, 1, '(1 file, 1 function, 1 method)'),
            ('srv/store', 1, 0, 1, 0, '(1 file, 1 function)'),
            ('style', 4, 0, 0, 0, '(4 files)'),
            ('templates', 3, 0, 0, 0, '(3 files)'),
            ('tests', 1, 0, 1, 0, '(1 file, 1 function)'),
            ('vendor/lib', 1, 0, 1, 0, '(1 file, 1 function)'),
            ('web', 3, 1, 2, 0, '(3 files, 1 class, 2 functions)'),
            ('zig', 2, 0, 1, 0, '(2 files, 1 function)'),
        ],
    ),
    "file_spans": (
        "path VARCHAR, first_line INTEGER, last_line INTEGER",
        [
            ('app/Models/User.php', 2, 3),
            ('app/broken.py', 1, 2),
            ('app/main.py', 1, 17),
            ('app/store.py', 1, 18),
            ('app/util.py', 1, 16),
            ('c/main.c', 3, 5),
            ('c/util.h', 1, 3),
            ('cs/Program.cs', 3, 8),
            ('cs/lib/Tools.cs', 1, 3),
            ('db/schema.sql', 1, 6),
            ('docs/guide.md', 1, 21),
            ('docs/notes.txt', 1, 13),
            ('docs/setup.md', 1, 5),
            ('ios/App.swift', 3, 6),
            ('node_modules/a.js', 1, 1),
            ('php/index.php', 3, 6),
            ('rb/run.rb', 2, 3),
            ('rb/tool.rb', 1, 1),
            ('src/lib.rs', 3, 10),
            ('src/main/java/org/demo/App.java', 5, 8),
            ('src/main/java/org/demo/Part.java', 2, 3),
            ('src/model.rs', 1, 1),
            ('srv/main.go', 5, 13),
            ('srv/store/db.go', 3, 7),
            ('style/_mix.scss', 1, 2),
            ('style/app.scss', 2, 2),
            ('style/base.css', 1, 1),
            ('style/main.css', 3, 8),
            ('templates/used.html', 1, 3),
            ('tests/test_util.py', 1, 5),
            ('vendor/lib/x.py', 1, 2),
            ('web/lib.ts', 1, 3),
            ('web/page.ts', 2, 6),
            ('zig/lib.zig', 1, 2),
            ('zig/main.zig', 2, 5),
        ],
    ),
    "route_verdicts": (
        "pid VARCHAR, location VARCHAR, key VARCHAR, tag VARCHAR, verdict VARCHAR",
        [
            ('/reports/orphaned-view', 'web/page.ts', '/reports/orphaned-view', 'route', 'orphan'),
            ('add_entry', 'app/main.py', '/ledger/{id}/forgotten-entry', 'route', 'orphan'),
            ('show_profile', 'app/main.py', '/users/profile', 'route', 'reached'),
        ],
    ),
    "template_verdicts": (
        "pid VARCHAR, location VARCHAR, key VARCHAR, tag VARCHAR, verdict VARCHAR",
        [
            ('base.html', 'templates/base.html', 'base.html', 'template', 'external'),
            ('dead.html', 'templates/dead.html', 'dead.html', 'template', 'orphan'),
            ('used.html', 'templates/used.html', 'used.html', 'template', 'reached'),
        ],
    ),
    "distinctive_tokens": (
        "route VARCHAR, token VARCHAR, external BOOLEAN",
        [
            ('/a/b', None, False),
            ('/health', 'health', True),
            ('/konto/:id/hint-page', 'hint-page', False),
            ('/same/size/four', 'same', False),
            ('/static/x.css', 'static', True),
            ('/users/{id}/profile', 'profile', False),
        ],
    ),
    "dead_definitions": (
        "file VARCHAR, qualified VARCHAR",
        [
            ('app/store.py', 'Store.unused_step'),
            ('app/util.py', 'leftover'),
            ('vendor/lib/x.py', 'vendored'),
        ],
    ),
    "off_graph_rules": (
        "id INTEGER, language VARCHAR, name VARCHAR, reachable BOOLEAN, claims_dead BOOLEAN, public BOOLEAN",
        [
            (0, 'python', 'visit_x', True, True, False),
            (1, 'python', 'x', False, True, False),
            (2, 'typescript', 'x', False, True, False),
            (3, 'typescript', 'x', True, True, False),
            (4, 'go', 'Open', True, True, False),
            (5, 'go', 'open', False, True, False),
            (6, 'rust', 'f', True, True, False),
            (7, 'rust', 'f', False, True, False),
            (8, 'java', 'f', True, True, True),
            (9, 'java', 'f', False, True, False),
            (10, 'csharp', 'f', True, True, False),
            (11, 'cpp', 'f', False, True, False),
            (12, 'cpp', 'f', True, True, False),
            (13, 'cpp', 'f', False, True, False),
            (14, 'cpp', 'f', True, True, False),
            (15, 'php', '__get', True, True, False),
            (16, 'php', 'f', False, True, False),
            (17, 'swift', 'f', True, True, False),
            (18, 'swift', 'f', False, True, False),
            (19, 'zig', 'f', True, True, True),
            (20, 'zig', 'f', False, True, False),
            (21, 'ruby', 'f', True, False, False),
        ],
    ),
    "protocol_witnesses": (
        "file VARCHAR, qualified VARCHAR",
        [
            ('a.swift', 'Job.hash'),
            ('a.swift', 'Job.start'),
            ('b.swift', 'View.layout'),
        ],
    ),
    "flaggable_nodes": (
        "path VARCHAR, name VARCHAR, start_line INTEGER",
        [
            ('app/store.py', 'save', 17),
            ('app/util.py', '_private', 15),
            ('app/util.py', 'clean', 7),
            ('app/util.py', 'helper', 1),
            ('app/util.py', 'leftover', 11),
            ('vendor/lib/x.py', 'vendored', 1),
        ],
    ),
    "health_report": (
        "turn INTEGER, line VARCHAR",
        [
            (1, 'UNREFERENCED (no mention elsewhere in this scan): util.py:leftover@11, util.py:_private@15, util.h:point@1, Tools.cs:Kind@2, schema.sql:names@6, run.rb:call!@3, tool.rb:Tool@1, lib.rs:find@6, db.go:Rows@3, db.go:Open@6, _mix.scss:$gap@1, _mix.scss:wide@2'),
        ],
    ),
    "family_lines": (
        "turn INTEGER, line VARCHAR",
        [
            (1, '  m.py:extract_odd — calls read_node but not record (8/9 peers do)  [strength 4.1]'),
            (2, '      e.g. siblings that conform: m.py:extract_0, m.py:extract_1, m.py:extract_2'),
        ],
    ),
    "role_lenses": (
        "lenses VARCHAR, site VARCHAR",
        [
            ('', 'b.py:load_x'),
            ('', 'b.py:load_z'),
            ('', 'b.py:scan_x'),
            ('', 't.py:load_y'),
            ('cluster', 'b.py:load_x'),
            ('cluster', 'b.py:load_z'),
            ('cluster', 'b.py:scan_x'),
            ('graph', 'b.py:load_x'),
            ('graph', 'b.py:scan_x'),
            ('graph', 't.py:load_y'),
            ('name', 'b.py:load_x'),
            ('name', 'b.py:load_z'),
            ('name', 't.py:load_y'),
            ('name+cluster+graph', 'b.py:load_x'),
        ],
    ),
    "noise_callees": (
        "name VARCHAR, noise BOOLEAN, role VARCHAR",
        [
            ('ValueError', True, 'ValueError'),
            ('append', True, 'append'),
            ('len', True, 'len'),
            ('read_node', False, 'read'),
            ('record', False, 'record'),
            ('splitlines', True, 'splitlines'),
        ],
    ),
    "important_files": (
        "path VARCHAR",
        [
            ('app/Models/User.php',),
            ('app/main.py',),
            ('app/store.py',),
            ('app/util.py',),
            ('c/main.c',),
            ('c/util.h',),
            ('cs/Program.cs',),
            ('cs/lib/Tools.cs',),
            ('docs/guide.md',),
            ('docs/setup.md',),
            ('ios/App.swift',),
            ('php/index.php',),
            ('rb/run.rb',),
            ('rb/tool.rb',),
            ('src/lib.rs',),
            ('src/main/java/org/demo/App.java',),
            ('src/main/java/org/demo/Part.java',),
            ('src/model.rs',),
            ('srv/main.go',),
            ('srv/store/db.go',),
            ('style/_mix.scss',),
            ('style/app.scss',),
            ('style/base.css',),
            ('style/main.css',),
            ('tests/test_util.py',),
            ('tsconfig.json',),
            ('web/lib.ts',),
            ('web/page.ts',),
            ('zig/lib.zig',),
            ('zig/main.zig',),
        ],
    ),
    "file_inventory": (
        "folder VARCHAR, names VARCHAR, hidden BIGINT",
        [
            ('(root)', 'tsconfig.json, docker-compose.yml, img.PNG, package.json, pyproject.toml', 0),
            ('app/Models/', 'User.php', 0),
            ('app/main.py/', 'main.py', 0),
            ('app/store.py/', 'store.py', 0),
            ('app/util.py/', 'util.py', 0),
            ('c/main.c/', 'main.c', 0),
            ('c/util.h/', 'util.h', 0),
            ('cs/Program.cs/', 'Program.cs', 0),
            ('cs/lib/', 'Tools.cs', 0),
            ('db/schema.sql/', 'schema.sql', 0),
            ('src/main/', 'App.java, Part.java', 0),
        ],
    ),
    "cluster_totals": (
        "cluster VARCHAR, n_files BIGINT, first_files VARCHAR",
        [
            ('config', 4, 'docker-compose.yml, package.json, pyproject.toml'),
            ('core_logic', 1, 'app/Models/User.php'),
            ('documentation', 2, 'docs/guide.md, docs/setup.md'),
            ('entry_points', 11, 'app/main.py, c/main.c, cs/Program.cs'),
            ('other', 21, 'app/broken.py, app/store.py, app/util.py'),
            ('schema', 1, 'db/schema.sql'),
            ('tests', 1, 'tests/test_util.py'),
            ('utilities', 2, 'style/_mix.scss, style/base.css'),
        ],
    ),
    "cluster_contents": (
        "cluster VARCHAR, path VARCHAR, type VARCHAR, name VARCHAR",
        [
            ('core_logic', 'app/Models/User.php', 'class', 'User'),
            ('entry_points', 'app/main.py', 'function', 'add_entry'),
            ('entry_points', 'app/main.py', 'function', 'show_profile'),
            ('entry_points', 'c/main.c', 'function', 'main'),
            ('entry_points', 'cs/Program.cs', 'class', 'Program'),
        ],
    ),
    "file_members": (
        "file VARCHAR, type VARCHAR, name VARCHAR, centrality DOUBLE, rank INTEGER",
        [
            ('app/Models/User.php', 'class', 'User', 0.0, 1),
            ('app/broken.py', 'class', 'Half (fallback)', 0.0, 1),
            ('app/broken.py', 'function', 'f (fallback)', 0.0, 1),
            ('app/main.py', 'function', 'add_entry', 1.0, 2),
            ('app/main.py', 'function', 'main', 0.2, 3),
            ('app/main.py', 'function', 'show_profile', 3.0, 1),
            ('app/store.py', 'class', 'Store', 2.0, 1),
            ('app/store.py', 'function', 'save', 3.0, 1),
            ('app/util.py', 'function', '_private', 0.0, 4),
            ('app/util.py', 'function', 'clean', 2.0, 2),
            ('app/util.py', 'function', 'helper', 5.0, 1),
            ('app/util.py', 'function', 'leftover', 0.0, 3),
        ],
    ),
    "next_steps": (
        "turn INTEGER, line VARCHAR",
        [
            (1, 'scan_directory("app/")'),
            (2, 'scan_directory("c/")'),
            (3, 'scan_file("app/util.py")'),
        ],
    ),
    "preview_report": (
        "section INTEGER, turn INTEGER, line VARCHAR",
        [
            (0, 0, '━━━ FOLDERS ━━━'),
            (0, 1, '  app/                 5    py:4 php:1               798.0B'),
            (0, 10, '  rb/                  2    rb:2                     74.0B'),
            (0, 2, '  (root)/              5    json:2 PNG:1 toml:1 ...  386.0B'),
            (0, 3, '  src/                 4    java:2 rs:2              333.0B'),
            (0, 4, '  style/               4    css:2 scss:2             207.0B'),
            (0, 5, '  templates/           3    html:3                   233.0B'),
            (0, 6, '  web/                 3    ts:2 js:1                231.0B'),
            (0, 7, '  docs/                3    md:2 txt:1               226.0B'),
            (0, 8, '  c/                   2    c:1 h:1                  99.0B'),
            (0, 9, '  cs/                  2    cs:2                     188.0B'),
            (1, 0, '━━━ FILE ARCHETYPES ━━━'),
            (1, 1, '  active_core: web/lib.ts  3d ago  51.0B'),
            (1, 10, '  stable_utilities: app/store.py  1mo ago  301.0B'),
            (1, 11, '  stable_utilities: c/util.h  1mo ago  29.0B'),
            (1, 2, '  active_core: web/page.ts  2d ago  171.0B'),
            (1, 3, '  active_core: zig/lib.zig  1d ago  30.0B'),
            (1, 4, '  potentially_stale: app/broken.py  1mo ago  37.0B'),
            (1, 5, '  potentially_stale: app/main.py  1mo ago  279.0B'),
            (1, 6, '  potentially_stale: c/main.c  1mo ago  70.0B'),
            (1, 7, '  potentially_stale: cs/Program.cs  1mo ago  136.0B'),
            (1, 8, '  stable_utilities: app/util.py  1mo ago  160.0B'),
            (1, 9, '  stable_utilities: app/Models/User.php  1mo ago  21.0B'),
            (2, 0, '━━━ ENTRY POINTS ━━━'),
            (2, 1, '  app/main.py:main() @16'),
            (2, 10, '  package.json:draw @3'),
            (2, 11, '  php/index.php:HomeController @3'),
            (2, 12, '  php/index.php:/home @7'),
            (2, 13, '  pyproject.toml:project_scripts @1'),
            (2, 14, '  pyproject.toml:python_project @1'),
            (2, 15, '  src/lib.rs:works @9'),
            (2, 16, '  src/main/java/org/demo/App.java:public static void main @6'),
            (2, 17, '  srv/main.go:func main() @11'),
            (2, 18, '  srv/main.go:/health @12'),
            (2, 19, '  style/main.css::root @2'),
            (2, 2, '  app/main.py:if __name__ @20'),
            (2, 20, '  tsconfig.json:typescript_project @1'),
            (2, 3, '  c/main.c:main @3'),
            (2, 4, '  cs/Program.cs:Main @5'),
            (2, 5, '  docker-compose.yml:docker_compose_project @1'),
            (2, 6, '  docker-compose.yml:services @1'),
            (2, 7, '  ios/App.swift:Demo @3'),
            (2, 8, '  package.json:npm_project @1'),
            (2, 9, '  package.json:web/page.js @2'),
            (3, 0, '━━━ CORE FILES (by centrality) ━━━'),
            (3, 1, '  app/util.py: imports 0, used by 2 files'),
            (3, 10, '  rb/tool.rb: imports 0, used by 1 files'),
            (3, 11, '  src/main/java/org/demo/Part.java: imports 0, used by 1 files'),
            (3, 12, '  src/model.rs: imports 0, used by 1 files'),
            (3, 13, '  srv/store/db.go: imports 0, used by 1 files'),
            (3, 14, '  style/_mix.scss: imports 0, used by 1 files'),
            (3, 15, '  style/base.css: imports 0, used by 1 files'),
            (3, 16, '  web/lib.ts: imports 0, used by 1 files'),
            (3, 17, '  zig/lib.zig: imports 0, used by 1 files'),
            (3, 18, '  c/main.c: imports 1, used by 0 files'),
            (3, 19, '  cs/Program.cs: imports 1, used by 0 files'),
            (3, 2, '  src/main/java/org/demo/App.java: imports 1, used by 1 files'),
            (3, 20, '  docs/guide.md: imports 1, used by 0 files'),
            (3, 3, '  web/page.ts: imports 1, used by 1 files'),
            (3, 4, '  app/Models/User.php: imports 0, used by 1 files'),
            (3, 5, '  app/main.py: imports 2, used by 0 files'),
            (3, 6, '  app/store.py: imports 0, used by 1 files'),
            (3, 7, '  c/util.h: imports 0, used by 1 files'),
            (3, 8, '  cs/lib/Tools.cs: imports 0, used by 1 files'),
            (3, 9, '  docs/setup.md: imports 0, used by 1 files'),
            (4, 0, '━━━ ARCHITECTURE ━━━'),
            (4, 1, '  config: 4 files: docker-compose.yml, package.json, pyproject.toml'),
            (4, 2, '  core_logic: 1 files: app/Models/User.php'),
            (4, 3, '  documentation: 2 files: docs/guide.md, docs/setup.md'),
            (4, 4, '  entry_points: 11 files: app/main.py, c/main.c, cs/Program.cs'),
            (4, 5, '  other: 21 files: app/broken.py, app/store.py, app/util.py'),
            (4, 6, '  schema: 1 files: db/schema.sql'),
            (4, 7, '  tests: 1 files: tests/test_util.py'),
            (4, 8, '  utilities: 2 files: style/_mix.scss, style/base.css'),
            (5, 0, '━━━ KEY DEPENDENCIES ━━━'),
            (5, 1, '  app/main.py imports app/store.py, app/util.py'),
            (5, 2, '  src/main/java/org/demo/App.java imports src/main/java/org/demo/Part.java'),
            (5, 3, '  web/page.ts imports web/lib.ts'),
            (6, 0, '━━━ HOT FUNCTIONS (most called) ━━━'),
            (6, 1, '  helper: called by 2, calls 1 @app/util.py'),
            (6, 10, '  main: called by 0, calls 1 @app/main.py'),
            (6, 2, '  show_profile: called by 5, calls 1 @app/main.py'),
            (6, 3, '  save: called by 1, calls 1 @app/store.py'),
            (6, 4, '  Store: called by 1, calls 0 @app/store.py'),
            (6, 5, '  clean: called by 1, calls 0 @app/util.py'),
            (6, 6, '  paint: called by 1, calls 0 @web/lib.ts'),
            (6, 7, '  add_entry: called by 0, calls 1 @app/main.py'),
            (6, 8, '  test_helper: called by 0, calls 1 @tests/test_util.py'),
            (6, 9, '  draw: called by 0, calls 1 @web/page.ts'),
            (8, 0, '━━━ FILE INVENTORY ━━━'),
            (8, 1, '  (root) tsconfig.json, docker-compose.yml, img.PNG, package.json, pyproject.toml'),
            (8, 10, '  db/schema.sql/ schema.sql'),
            (8, 11, '  src/main/ App.java, Part.java'),
            (8, 2, '  app/Models/ User.php'),
            (8, 3, '  app/main.py/ main.py'),
            (8, 4, '  app/store.py/ store.py'),
            (8, 5, '  app/util.py/ util.py'),
            (8, 6, '  c/main.c/ main.c'),
            (8, 7, '  c/util.h/ util.h'),
            (8, 8, '  cs/Program.cs/ Program.cs'),
            (8, 9, '  cs/lib/ Tools.cs'),
            (9, 0, '━━━ NEXT STEPS ━━━'),
            (9, 1, '  scan_directory("templates/")'),
            (9, 2, '  scan_directory("tests/")'),
            (9, 3, '  scan_file("app/util.py")'),
        ],
    ),
    "search_report": (
        "path VARCHAR, type VARCHAR, name VARCHAR, hits BIGINT, file_total BIGINT",
        [
            ('app/main.py', 'function', 'add_entry', 1, 2),
            ('app/main.py', 'function', 'show_profile', 1, 2),
            ('app/store.py', 'function', 'save', 1, 4),
            ('app/store.py', 'method', 'size', 1, 4),
            ('app/store.py', 'method', 'unused_step', 1, 4),
            ('app/store.py', 'method', 'visit_row', 1, 4),
            ('app/util.py', 'function', '_private', 1, 5),
            ('app/util.py', 'function', 'clean', 1, 5),
            ('app/util.py', 'function', 'helper', 2, 5),
            ('app/util.py', 'function', 'leftover', 1, 5),
            ('c/main.c', 'function', 'main', 1, 1),
            ('vendor/lib/x.py', 'function', 'vendored', 1, 1),
            ('web/page.ts', None, None, 1, 2),
            ('web/page.ts', 'function', 'draw', 1, 2),
        ],
    ),
    "collapsed_folders": (
        "dir VARCHAR, label VARCHAR, n_files BIGINT, size BIGINT",
        [
            ('.', '', 5, 386),
            ('app', 'app', 4, 777),
            ('c', 'c', 2, 99),
            ('cs', 'cs/lib', 2, 188),
            ('db', 'db', 1, 151),
            ('docs', 'docs', 3, 226),
            ('ios', 'ios', 1, 66),
            ('node_modules', 'node_modules', 1, 16),
            ('php', 'php', 1, 116),
            ('rb', 'rb', 2, 74),
            ('src', 'src', 2, 135),
            ('srv', 'srv/store', 2, 208),
            ('style', 'style', 4, 207),
            ('templates', 'templates', 3, 233),
            ('tests', 'tests', 1, 70),
            ('vendor', 'vendor/lib', 1, 29),
            ('web', 'web', 3, 231),
            ('zig', 'zig', 2, 101),
        ],
    ),
    "python_call_rows": (
        "caller_file VARCHAR, caller_name VARCHAR, callee_name VARCHAR, line INTEGER",
        [
            ('app/main.py', None, 'get', 6),
            ('app/main.py', None, 'main', 21),
            ('app/main.py', None, 'post', 11),
            ('app/main.py', 'add_entry', 'save', 13),
            ('app/main.py', 'main', 'show_profile', 17),
            ('app/main.py', 'show_profile', 'helper', 8),
            ('app/store.py', 'save', 'Store', 18),
            ('app/store.py', 'size', 'len', 6),
            ('app/store.py', 'unused_step', 'append', 13),
            ('app/util.py', 'clean', 'str', 8),
            ('app/util.py', 'helper', 'clean', 3),
        ],
    ),
    "image_colours": (
        "path VARCHAR, rank INTEGER, colour VARCHAR, share DOUBLE",
        [
            ('filters.png', 1, '#ff0000', 0.6),
            ('filters.png', 2, '#7f00ff', 0.1),
            ('filters.png', 3, '#bf007f', 0.1),
            ('palette.png', 1, '#008000', 0.6667),
            ('palette.png', 2, '#000000', 0.3333),
        ],
    ),
    "template_rows": (
        "path VARCHAR, node_id INTEGER, parent_id INTEGER, type VARCHAR, name VARCHAR, start_line INTEGER, end_line INTEGER, dialect VARCHAR",
        [
            ('a.html', 0, -1, 'block', "extends 'base.html'", 1, 1, 'jinja'),
            ('a.html', 1, -1, 'block', 'block body', 2, 5, 'jinja'),
            ('a.html', 2, 1, 'block', 'for x in xs', 3, 4, 'jinja'),
            ('a.html', 3, 2, 'expression', 'x.name', 4, 4, 'jinja'),
            ('b.blade.php', 0, -1, 'block', "section ('main')", 1, 5, 'blade'),
            ('b.blade.php', 1, 0, 'block', 'if ($a)', 2, 4, 'blade'),
            ('b.blade.php', 2, 1, 'expression', '$b', 3, 3, 'blade'),
            ('c.svelte', 0, -1, 'block', 'if ok', 1, 5, 'svelte'),
            ('c.svelte', 1, 0, 'block', 'each items as i', 2, 4, 'svelte'),
            ('c.svelte', 2, 1, 'expression', 'i', 3, 3, 'svelte'),
        ],
    ),
    "type_references": (
        "src VARCHAR, dst VARCHAR",
        [
            ('a.swift', 'b.swift'),
        ],
    ),
    "review_report": (
        "turn INTEGER, line VARCHAR",
        [
            (1, 'orphan: route /ledger/{id}/forgotten-entry  (add_entry)'),
            (2, 'orphan: route /reports/orphaned-view  (/reports/orphaned-view)'),
            (3, 'candidate-dead: leftover  (app/util.py)'),
            (4, 'drift: helper calls clean but (unlike peers) not check'),
        ],
    ),
    "page_elements": (
        "path VARCHAR, source VARCHAR, node_id INTEGER, type VARCHAR, name VARCHAR, start_line INTEGER, end_line INTEGER, parent INTEGER",
        [
            ('p.html', 'html', 0, 'doctype', 'doctype html', 1, 1, None),
            ('p.html', 'html', 1, 'section', 'main#top', 2, 11, None),
            ('p.html', 'html', 2, 'heading', 'h1: One two', 3, 3, None),
            ('p.html', 'html', 3, 'list', 'ul', 5, 9, 0),
            ('p.html', 'html', 4, 'form', 'form', 12, 12, None),
            ('p.html', 'template', 0, 'block', 'block body', 4, 10, None),
            ('p.html', 'template', 1, 'block', 'for x in xs', 6, 8, 0),
            ('p.html', 'template', 2, 'expression', 'x', 7, 7, 1),
            ('templates/dead.html', 'template', 0, 'block', 'block body', 1, 1, None),
            ('templates/used.html', 'html', 0, 'form', 'form', 1, 1, None),
            ('templates/used.html', 'html', 1, 'list', 'ul', 2, 2, None),
            ('templates/used.html', 'html', 2, 'table', 'table', 3, 3, None),
        ],
    ),
}
