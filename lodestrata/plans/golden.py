"""Small source files with the chunks that the format prescribes for them, for the chunkers that SQL can't express."""

from __future__ import annotations

SCRIPT = {
    "lib/sum.ts": "\n// adds up\nexport function sum(a: number, b: number): number {\n  return a + b;\n}\n\n/**\n * Halves it.\n */\nfunction half(a: number): number {\n  return a / 2;\n}\n\nexport async function load(url: string): Promise<string> {\n  return await get(url);\n}\n",
    "lib/shapes.ts": "export interface Shape {\n  id: string;\n}\n\nexport class Box extends Base {\n  close() { return \"}\"; }\n}\n\nexport abstract class Frame {\n  abstract draw(): void;\n}\n",
    "lib/kinds.ts": "type State = 'on' | 'off';\n\nexport type Level = 'low' | 'high';\n\nexport enum Tone {\n  Dark,\n}\n\nexport const enum Side {\n  Left = 1,\n}\n",
    "lib/arrows.ts": "export const typed = (name: string): string => {\n  return name;\n};\n\nexport const plain = (a) => a + 1;\n\nconst later = async (job) => {\n  await job();\n};\n",
    "lib/empty.ts": "",
    "lib/constants.ts": "const A = 1;\nconst B = 2;\n",
}
SCRIPT_CHUNKS = [
    ("lib/sum.ts", "sum", "function", 2, 5), ("lib/sum.ts", "half", "function", 7, 12), ("lib/sum.ts", "load", "function", 14, 16),
    ("lib/shapes.ts", "Shape", "interface", 1, 3), ("lib/shapes.ts", "Box", "class", 5, 7), ("lib/shapes.ts", "Frame", "class", 9, 11),
    ("lib/kinds.ts", "State", "type", 1, 1), ("lib/kinds.ts", "Level", "type", 3, 3), ("lib/kinds.ts", "Tone", "enum", 5, 7), ("lib/kinds.ts", "Side", "enum", 9, 11),
    ("lib/arrows.ts", "plain", "arrow_function", 5, 6), ("lib/arrows.ts", "later", "arrow_function", 7, 9),
    ("lib/empty.ts", "lib/empty.ts", "file", 1, 1), ("lib/constants.ts", "lib/constants.ts", "file", 1, 3),
]
PHP = {
    "app/tools.php": "<?php\n\n/**\n * Adds up.\n */\nfunction sum($a, $b) {\n    return $a + $b;\n}\n\nfunction half($a) {\n    return $a / 2;\n}\n",
    "app/Cart.php": "<?php\n\nnamespace Shop\\Models;\n\n#[Table]\nfinal class Cart extends Base\n{\n    public function add($x) { return '}'; }\n}\n",
    "app/Parts.php": "<?php\n\nnamespace Shop\\Parts;\n\ninterface Store\n{\n    public function all(): array;\n}\n\ntrait Stamped\n{\n    public $at;\n}\n\nenum Tone: string\n{\n    case Dark = 'dark';\n}\n",
    "app/empty.php": "<?php\n",
}
PHP_CHUNKS = [
    ("app/tools.php", "sum", "function", 3, 8), ("app/tools.php", "half", "function", 10, 12), ("app/Cart.php", "Shop\\Models\\Cart", "class", 5, 9),
    ("app/Parts.php", "Store", "interface", 5, 8), ("app/Parts.php", "Stamped", "trait", 10, 13), ("app/Parts.php", "Tone", "enum", 15, 18), ("app/empty.php", "app/empty.php", "file", 1, 2),
]
GO = {
    "cmd/run.go": "package main\n\nimport \"os\"\n\n// Kinds of things.\ntype (\n\tNode struct{ id int }\n\tWalker interface{}\n)\n\n// Run starts\n// it.\nfunc Run(name string) error {\n\treturn nil // }\n}\n\nfunc (t *Tree) Cut() {}\n\nfunc (t Tree[K]) Grow() {}\n",
    "cmd/values.go": "package main\n\nconst A = 1\n",
    "cmd/broken.go": "package main\n\nfunc f( {\n",
}
GO_CHUNKS = [
    ("cmd/run.go", "Node", "struct", 5, 9), ("cmd/run.go", "Walker", "interface", 5, 9), ("cmd/run.go", "Run", "function", 11, 15), ("cmd/run.go", "Tree.Cut", "method", 17, 17), ("cmd/run.go", "Grow", "method", 19, 19),
    ("cmd/values.go", "values.go", "file", 1, 4), ("cmd/broken.go", "broken.go", "file", 1, 4),
]
SETS = {"typescript": (SCRIPT, SCRIPT_CHUNKS), "php": (PHP, PHP_CHUNKS), "go": (GO, GO_CHUNKS)}
COLUMNS = ("file_path", "symbol", "symbol_type", "start_line", "end_line")


def values(kind: str) -> str:
    """The prescribed chunks as SQL."""
    quoted = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"select * from (values {', '.join('(' + ', '.join(map(quoted, row)) + ')' for row in SETS[kind][1])}) as t({', '.join(COLUMNS)})"
