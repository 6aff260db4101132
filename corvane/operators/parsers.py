"""Extracting symbols, imports, comments and markers from source text.

Rules are data; one interpreter applies them line by line: lines are exploded
with their number, a CASE picks the first rule that matches, and window
functions carry what a later line needs to know of an earlier one. No Python
runs per row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import base_name, extension

#: Language of each extension.
LANGUAGES = {
    "elixir": "ex exs", "erlang": "erl hrl", "gleam": "gleam", "typescript": "ts", "tsx": "tsx", "javascript": "js jsx mjs cjs", "php": "php", "python": "py",
    "rust": "rs", "go": "go", "java": "java", "kotlin": "kt kts", "scala": "scala", "groovy": "groovy gvy gy gsh", "c": "c h", "cpp": "cpp cc cxx hpp",
    "objective-c": "m", "csharp": "cs", "fsharp": "fs fsx", "vb": "vb", "swift": "swift", "dart": "dart", "ruby": "rb", "lua": "lua", "r": "r", "julia": "jl",
    "perl": "pl pm", "bash": "sh bash zsh", "powershell": "ps1 psm1 psd1", "clojure": "clj cljs", "haskell": "hs", "ocaml": "ml mli", "zig": "zig",
    "assembly": "asm s", "terraform": "tf hcl", "config": "yaml yml toml json",
}
#: Extensions of binary files.
BINARY = "png jpg jpeg gif bmp webp ico svg pdf doc docx xls xlsx ppt pptx zip tar gz tgz bz2 xz zst 7z rar mp3 mp4 wav flac ogg avi mkv mov woff woff2 ttf otf eot so dylib dll exe o a lib class jar wasm db sqlite sqlite3".split()
_BY_EXTENSION = {f".{e}": lang for lang, es in LANGUAGES.items() for e in es.split()}


def language(path: Column) -> Column:
    """A path's language by its extension, else ``unknown``."""
    table = F.create_map(*[F.lit(x) for pair in _BY_EXTENSION.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("unknown"))


def supported(path: Column) -> Column:
    """Whether a path's extension has a language."""
    return extension(path).isin(*_BY_EXTENSION)


def binary(path: Column) -> Column:
    """Whether a path's extension is that of a binary file."""
    return extension(path).isin(*[f".{e}" for e in BINARY])


@dataclass(frozen=True)
class Rule:
    """A line that matches ``pattern`` (trimmed) is a symbol of ``kind``; its name is the pattern's ``group``."""

    kind: str
    pattern: str
    group: int = 1
    visibility: str = "public"  # public, private, pub, capital, underscore, export
    qualified: str | None = None  # a format of groups, as "$1.$2"


_FALLBACK = [Rule("function", r"^(?:function|def|fn|func)\s+(\w+)"), Rule("class", r"^(?:class|struct|type)\s+(\w+)")]
#: What a line must look like, by family; the first rule that matches wins.
RULES: dict[str, list[Rule]] = {
    "rust": [
        Rule("function", r"^(?:pub\s+)?(?:async\s+)?fn\s+(\w+)", visibility="pub"), Rule("struct", r"^(?:pub\s+)?struct\s+(\w+)", visibility="pub"),
        Rule("enum", r"^(?:pub\s+)?enum\s+(\w+)", visibility="pub"), Rule("trait", r"^(?:pub\s+)?trait\s+(\w+)", visibility="pub"), Rule("impl", r"^impl(?:<[^>]+>)?\s+([\w:]+)"),
    ],
    "go": [
        Rule("function", r"^func\s+(?:\(\w+\s+\*?\w+\)\s+)?(\w+)\s*\(", visibility="capital"), Rule("struct", r"^type\s+(\w+)\s+struct"),
        Rule("interface", r"^type\s+(\w+)\s+interface"), Rule("type", r"^type\s+(\w+)\s+"),
    ],
    "python": [Rule("function", r"^(?:async\s+)?def\s+(\w+)\s*\(", visibility="underscore"), Rule("class", r"^class\s+(\w+)[\s:(]"), Rule("decorator", r"^@([\w.]+)")],
    "typescript": [
        Rule("class", r"(?:export\s+)?(?:abstract\s+)?class\s+(\w+)"), Rule("function", r"(?:export\s+)?(?:async\s+)?function\s+(\w+)", visibility="export"),
        Rule("function", r"export\s+(?:const|let)\s+(\w+)\s*=\s*(?:async\s+)?(?:\(|function)"), Rule("interface", r"(?:export\s+)?interface\s+(\w+)"),
        Rule("type", r"(?:export\s+)?type\s+(\w+)\s*="), Rule("enum", r"(?:export\s+)?(?:const\s+)?enum\s+(\w+)"), Rule("decorator", r"^@(\w+)\s*[\(\{]?"),
    ],
    "dart": [
        Rule("class", r"^(?:abstract\s+)?class\s+(\w+)(?:\s+extends\s+([\w<>?]+))?"), Rule("mixin", r"^mixin\s+(\w+)"), Rule("extension", r"^extension\s+(\w+)\s+on"),
        Rule("enum", r"^enum\s+(\w+)"), Rule("type", r"^typedef\s+(\w+)"),
        Rule("function", r"^(?:static\s+)?(?:Future<[^>]*>|Stream<[^>]*>|void|[\w<>?]+)\s+(\w+)\s*\(", visibility="underscore"), Rule("function", r"factory\s+(\w+)\s*[\.(]"),
    ],
    "terraform": [
        Rule("resource", r'^resource\s+"(\w+)"\s+"([\w-]+)"', 2, qualified="$1.$2"), Rule("module", r'^module\s+"([\w-]+)"'), Rule("variable", r'^variable\s+"([\w-]+)"'),
        Rule("output", r'^output\s+"([\w-]+)"'), Rule("provider", r'^provider\s+"([\w-]+)"'), Rule("data", r'^data\s+"(\w+)"\s+"([\w-]+)"', 2, qualified="data.$1.$2"),
        Rule("locals", r"^(locals)\s*\{"), Rule("terraform", r"^(terraform)\s*\{"),
    ],
    "elixir": [
        Rule("module", r"^defmodule\s+([\w.]+)"), Rule("function", r"^def\s+([\w?!]+)"), Rule("function", r"^defp\s+([\w?!]+)", visibility="private"),
        Rule("macro", r"^defmacrop?\s+([\w?!]+)"), Rule("struct", r"^(defstruct)\b"), Rule("type", r"^@typep?\s+(\w+)"), Rule("callback", r"^@callback\s+(\w+)"), Rule("behaviour", r"^@behaviour\s+([\w.]+)"), Rule("use", r"^use\s+([\w.]+)"),
    ],
    "java": [Rule("class", r"^(?:(?:public|private|protected|abstract|final|static|sealed|open|data)\s+)*(?:class|record|object)\s+(\w+)"), Rule("interface", r"^(?:(?:public|private|protected|sealed)\s+)*interface\s+(\w+)"), Rule("enum", r"^(?:(?:public|private|protected)\s+)*enum\s+(?:class\s+)?(\w+)"), Rule("function", r"^(?:(?:public|private|protected|internal|override|suspend|inline|open)\s+)*fun\s+(?:<[^>]+>\s+)?(?:[\w<>?]+\.)?(\w+)\s*\("), Rule("method", r"^(?:(?:public|private|protected|static|final|abstract|synchronized|override|virtual|async|internal)\s+)+[\w<>\[\],.? ]+\s+(\w+)\s*\([^;]*$")],
    "ruby": [Rule("module", r"^module\s+([\w:]+)"), Rule("class", r"^class\s+([\w:]+)"), Rule("method", r"^def\s+(?:self\.)?([\w?!=]+)")],
    "haskell": [Rule("type", r"^(?:data|newtype|type)\s+(\w+)"), Rule("class", r"^class\s+(?:.*=>\s*)?(\w+)"), Rule("function", r"^(\w+)\s*::")],
    "erlang": [Rule("module", r"^-module\((\w+)\)"), Rule("record", r"^-record\((\w+)"), Rule("function", r"^([a-z]\w*)\([^)]*\)\s*(?:when\b.*)?->")],
    "ocaml": [Rule("module", r"^module\s+(\w+)"), Rule("type", r"^type\s+(?:\S+\s+)?(\w+)\s*="), Rule("function", r"^let\s+(?:rec\s+)?(\w+)")],
    "r": [Rule("function", r"^([\w.]+)\s*(?:<-|=)\s*function\b")],
    "julia": [Rule("module", r"^module\s+(\w+)"), Rule("struct", r"^(?:mutable\s+)?struct\s+(\w+)"), Rule("macro", r"^macro\s+(\w+)"), Rule("function", r"^function\s+([\w!.]+)")],
    "zig": [Rule("function", r"^(?:pub\s+)?fn\s+(\w+)", visibility="pub"), Rule("struct", r"^(?:pub\s+)?const\s+(\w+)\s*=\s*(?:packed\s+|extern\s+)?struct", visibility="pub")],
    "gleam": [Rule("function", r"^(?:pub\s+)?fn\s+(\w+)", visibility="pub"), Rule("type", r"^(?:pub\s+)?type\s+(\w+)", visibility="pub")],
    "powershell": [Rule("function", r"(?i)^function\s+([\w-]+)"), Rule("class", r"(?i)^class\s+(\w+)")],
    "fsharp": [Rule("module", r"^module\s+([\w.]+)"), Rule("type", r"^type\s+(\w+)"), Rule("function", r"^let\s+(?:rec\s+|inline\s+)?(\w+)\s+[^=\s]")],
    "assembly": [Rule("function", r"^([A-Za-z_.]\w*):")],
    "generic": _FALLBACK,
}
_FAMILY = {"tsx": "typescript", "javascript": "typescript", "kotlin": "java", "csharp": "java", "groovy": "java", "zsh": "bash"}


def lines_of(files: DataFrame, text: str = "content") -> DataFrame:
    """``files`` exploded to lines: line_no (from 1), line, without the text."""
    return files.select("*", F.posexplode(F.split(F.col(text), "\n")).alias("_p", "line")).withColumn("line_no", F.col("_p") + 1).drop("_p", text)


def _visibility(rule: Rule, line: Column, name: Column) -> Column:
    private = {"pub": ~line.startswith("pub"), "capital": ~name.rlike("^[A-Z]"), "underscore": name.startswith("_"), "export": ~F.contains(line, F.lit("export"))}.get(rule.visibility)
    return F.lit(rule.visibility) if private is None else F.when(private, "private").otherwise("public")


def _first_rule(rules: list[Rule], line: Column) -> Column:
    cases = []
    for r in rules:
        name = F.regexp_extract(line, r.pattern, r.group)
        qualified = name if r.qualified is None else F.concat(*[F.regexp_extract(line, r.pattern, int(p[1])) if p[0] == "$" else F.lit(p) for p in __import__("re").findall(r"\$\d|[^$]+", r.qualified)])
        cases.append(F.when(line.rlike(r.pattern), F.struct(F.lit(r.kind).alias("kind"), name.alias("name"), qualified.alias("qualified_name"), _visibility(r, line, name).alias("visibility"))))
    return F.coalesce(*cases)


def _any_family(lang: Column, line: Column) -> Column:
    """The first rule of the language's family that a line matches."""
    known = [k for k in RULES if k != "generic"]
    case = F.when(~lang.isin(*known, *_FAMILY), _first_rule(RULES["generic"], line))
    for f in known:
        case = case.when(lang.isin(f, *[a for a, b in _FAMILY.items() if b == f]), _first_rule(RULES[f], line))
    return case


def line_symbols(files: DataFrame, family: str | None = None, text: str = "content", keep_line: bool = False) -> DataFrame:
    """(file columns, line_no, kind, name, qualified_name, visibility): the symbols that lines declare.

    The family of rules is that of the column ``language``, or ``family`` for
    all rows; languages without rules take the fallback. ``keep_line`` keeps the line itself.
    """
    cut = lines_of(files, text).withColumn("_l", F.trim(F.regexp_replace("line", r"\r$", "")))
    lang = F.lower(F.coalesce("language", F.lit("unknown"))) if not family else None
    found = _first_rule(RULES[family], F.col("_l")) if family else None
    if not family:  # so many rules are too much for one generated method: a lambda keeps them out of it
        found = F.element_at(F.transform(F.array(F.struct(lang.alias("g"), F.col("_l").alias("l"))), lambda x: _any_family(x["g"], x["l"])), 1)
    out = cut.withColumn("_s", found).filter("_s is not null")
    drop = [c for c in ("kind", "name", "qualified_name", "visibility") if c in files.columns]
    return out.drop(*([] if keep_line else ["line"]), "_l", *drop).select("*", "_s.*").drop("_s")


def yaml_type(path: Column, content: Column) -> Column:
    """Which tool a YAML file is for; the first that fits."""
    has = lambda t: F.contains(content, F.lit(t))
    return (
        F.when(has("apiVersion:"), "kubernetes").when(has("helm.sh/chart") | (base_name(path) == "values.yaml"), "helm")
        .when(has("runs-on:") | F.contains(path, F.lit(".github/workflows")), "github_actions").when(has("stages:") & has("script:"), "gitlab_ci")
        .when(has("services:") & (has("image:") | has("build:")), "docker_compose").otherwise("generic")
    )


def yaml_symbols(files: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """(key, yaml_type, line_no, kind, name, qualified_name) of YAML files (columns path, content; key unique).

    Kubernetes: a document's kind and name, carried forward to the line where
    both are known; workflows: name and jobs; pipelines: jobs; compose files: the
    services, volumes and networks under their section; others: top-level keys,
    at most 30 for charts and 20 else.
    """
    typed = files.select(key, *(["path"] if key != "path" else []), F.col(text).alias("content")).withColumn("yaml_type", yaml_type(F.col("path"), F.col("content")))
    cut = lines_of(typed).withColumn("line", F.regexp_replace("line", r"\s+$", ""))
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    grab = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    line, trimmed = F.col("line"), F.trim("line")
    carried = cut.withColumn("_doc", F.sum((line == "---").cast("int")).over(before)).withColumn("_kind", F.last(grab(trimmed, r"^kind:\s+(\w+)$"), True).over(before)).withColumn("_new", grab(trimmed, r"^name:\s+(.+)$"))
    section = grab(line, r"^([\w-]+):\s*$")
    carried = carried.withColumn("_section", F.last(F.when(line.rlike(r"^\S"), F.coalesce(section, F.lit("-"))), True).over(before))
    named = grab(line, r"^  (\w[\w-]*):\s*$")
    top = grab(line, r"^(\w[\w-]*):")
    block = grab(line, r"^(\w[\w-]*):\s*$")
    s = lambda kind, name, q=None: F.struct(kind.alias("kind") if isinstance(kind, Column) else F.lit(kind).alias("kind"), name.alias("name"), (q if q is not None else name).alias("qualified_name"))
    kinds = {"services": "service", "volumes": "volume", "networks": "network"}
    kind_of = F.coalesce(*[F.when(F.col("_section") == a, b) for a, b in kinds.items()])
    is_ = lambda t: F.col("yaml_type") == t
    case = (
        F.when(is_("kubernetes") & F.col("_kind").isNotNull() & F.col("_new").isNotNull(), s("resource", F.col("_new"), F.concat_ws("/", "_kind", "_new")))
        .when(is_("github_actions") & line.rlike(r"^name:\s+\S"), s("workflow", grab(trimmed, r"^name:\s+(.+)$")))
        .when(is_("github_actions") & named.isNotNull() & ~named.isin("steps", "with", "env", "strategy", "outputs", "needs"), s("job", named))
        .when(is_("gitlab_ci") & block.isNotNull() & ~block.isin("stages", "variables", "cache", "default", "workflow", "include"), s("job", block))
        .when(is_("docker_compose") & kind_of.isNotNull() & named.isNotNull(), s(kind_of, named))
        .when(is_("helm") & top.isNotNull(), s("config", top)).when(is_("generic") & block.isNotNull(), s("config", block))
    )
    found = carried.withColumn("_s", case).filter("_s is not null").select(key, "yaml_type", "line_no", "_s.*")
    first = Window.partitionBy(key, "qualified_name").orderBy("line_no")
    number = Window.partitionBy(key).orderBy("line_no")
    once = found.withColumn("_r", F.row_number().over(first)).filter("_r = 1").withColumn("_n", F.row_number().over(number))
    return once.filter(~is_("helm") | (F.col("_n") <= 30)).filter(~is_("generic") | (F.col("_n") <= 20)).drop("_r", "_n")


def nearest_above(rows: DataFrame, keys: list[str], line: str, is_note: Column, note: Column, max_gap: int | None = None) -> DataFrame:
    """Rows that are no notes, each with the last note of its group on an earlier line (within ``max_gap`` lines if given).

    A backward as-of join by one window over ranges of lines; of notes on one
    line the greatest text counts, and rows without a line have no note.
    """
    above = Window.partitionBy(*keys).orderBy(F.col(line).cast("bigint")).rangeBetween(Window.unboundedPreceding, -1)
    joined = rows.withColumn("_note", F.coalesce(is_note, F.lit(False))).withColumn("_last", F.max(F.when(F.col("_note") & F.col(line).isNotNull(), F.struct(F.col(line).alias("l"), note.alias("t")))).over(above))
    near = F.col(line).isNotNull() if max_gap is None else F.col(line) - F.col("_last.l") <= max_gap
    return joined.filter(~F.col("_note")).withColumn("note", F.when(near, F.col("_last.t"))).drop("_note", "_last")


#: How imports are written; the named languages, and all others.
IMPORTS = {
    "typescript": [r"""(?:import[^"']*|require\s*\()['"](.*?)['"]"""],
    "python": [r"(?m)^from\s+([\w.]+)\s+import", r"(?m)^import\s+([\w.]+)"],
    "elixir": [r"(?m)^\s*(?:alias|import|use)\s+([\w.]+)"],
    "generic": [r"""(?:import|require|use)\s+["']?([\w./]+)["']?"""],
}


def imports(content: Column, family: str) -> Column:
    """What a text imports, in order; for TypeScript without scoped packages."""
    found = F.concat(*[F.regexp_extract_all(content, F.lit(p), F.lit(1)) for p in IMPORTS[family]])
    return F.filter(found, lambda m: ~m.startswith("@")) if family == "typescript" else found


#: How documentation is written.
DOCS = {"python": (r'(?s)"""(.*?)"""', 20), "typescript": (r"(?s)/\*\*(.*?)\*/", 20), "elixir": (r'(?s)@(?:module)?doc\s+"""(.*?)"""', 10), "dart": (r"(?m)///\s*(.*)$", 10), "rust": (r"(?m)//[/!]\s*(.*)$", 10), "generic": (r"(?s)/\*\*(.*?)\*/", 10)}


def doc_comments(content: Column, family: str) -> Column:
    """The texts of a family's documentation comments that are long enough to say something."""
    pattern, least = DOCS[family]
    clean = F.transform(F.regexp_extract_all(content, F.lit(pattern), F.lit(1)), lambda d: F.regexp_replace(F.regexp_replace(d, r"\s*\*\s*", " ") if "*" in pattern else d, r"^\s+|\s+$", ""))
    return F.filter(clean, lambda d: F.length(d) > least)


#: Fixed values: (what begins a comment, markers) of notes of work to be done; the named families, and the grammar-based parsers as ``default``.
TODOS = {
    "default": (r"(?://|#|--)", "TODO|FIXME|HACK|XXX|DEBT"), "generic": (r"(?://|#)", "TODO|FIXME|HACK|XXX"), "elixir": ("#", "TODO|FIXME|HACK|XXX|NOCOMMIT|BUG|DEBT"),
    "python": ("#", "TODO|FIXME|HACK|XXX"), "typescript": ("//", "TODO|FIXME|HACK|XXX"), "dart": ("//", "TODO|FIXME|HACK|XXX"), "terraform": ("#", "TODO|FIXME|HACK"),
}


def todo_lines(files: DataFrame, family: str = "default", text: str = "content") -> DataFrame:
    """(file columns, line_no, todo): trimmed lines with a marker that begins a comment, whatever the case."""
    comment, markers = TODOS[family]
    return lines_of(files, text).filter(F.col("line").rlike(rf"(?i){comment}\s*({markers})\b")).withColumn("todo", F.trim("line")).drop("line")


def widget_type(name: Column, parent: Column, line: Column) -> Column:
    """What kind of widget or state holder a line declares, or null."""
    has = lambda text: F.contains(line, F.lit(text))
    own = lambda widget: (parent.isNull() | (parent == widget)) & has(widget)
    return (
        F.when(own("StatelessWidget"), "stateless_widget").when(own("StatefulWidget"), "stateful_widget").when(has("State<"), "widget_state").when(has("ChangeNotifier"), "provider_notifier")
        .when(has("Bloc") | has("Cubit"), "bloc").when(has("Riverpod") | has("Notifier"), "riverpod_notifier").when(name.endswith("Widget"), "widget")
    )


def line_metadata(language: Column, kind: Column, name: Column, line: Column) -> Column:
    """A map of what a declaring line tells beyond its name: a class's widget type, asynchronous functions, factories."""
    line = F.trim(line)
    widget = F.when((language == "dart") & (kind == "class"), widget_type(name, F.nullif(F.regexp_extract(line, r"\sextends\s+([\w<>?]+)", 1), F.lit("")), line))
    factory = (language == "dart") & (kind == "function") & ~line.rlike(r"^(?:static\s+)?(?:Future<[^>]*>|Stream<[^>]*>|void|[\w<>?]+)\s+(\w+)\s*\(")
    entry = lambda when, key, value: F.when(when, F.struct(F.lit(key).alias("k"), value.alias("v")))
    found = [
        entry(widget.isNotNull(), "widget_type", widget), entry(widget.isNotNull(), "framework", F.lit("flutter")),
        entry((language == "dart") & (kind == "function") & ~factory & F.contains(line, F.lit("async")), "async", F.lit("true")), entry(factory, "factory", F.lit("true")),
    ]
    return F.map_from_entries(F.array_compact(F.array(*found)))


CONTAINERS = "class module struct interface trait impl enum mixin extension object record".split()


def nested(symbols: DataFrame, keys: list[str]) -> DataFrame:
    """Symbols (keys, line_no, indent, kind, qualified_name) with ``qualified_name`` led by the containers they stand in, and ``line_end``.

    A symbol stands in the last container above it that is indented less and
    not followed by anything as little indented. One fold over a file's symbols
    keeps the open containers, another from the end what is below, so both cost
    no more than their number times their depth; ``line_end`` is the line before the next symbol that is no
    deeper, null for the last.
    """
    rest = [c for c in symbols.columns if c not in (*keys, "line_no", "indent", "kind", "qualified_name")]
    rows = symbols.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line_no", "indent", "kind", "qualified_name", F.struct(*rest).alias("rest") if rest else F.lit(0).alias("rest")))).alias("s"))
    opened = "array<struct<indent:int,name:string>>"
    start = F.struct(F.array().cast(opened).alias("open"), F.array().cast("array<string>").alias("names"))

    def step(state: Column, s: Column) -> Column:
        open_ = F.filter(state["open"], lambda o: o["indent"] < s["indent"])
        name = F.when(F.size(open_) > 0, F.concat_ws(".", F.element_at(open_, -1)["name"], s["qualified_name"])).otherwise(s["qualified_name"])
        added = F.concat(open_, F.array(F.struct(s["indent"].alias("indent"), name.alias("name"))))
        return F.struct(F.when(s["kind"].isin(*CONTAINERS), added).otherwise(open_).cast(opened).alias("open"), F.concat(state["names"], F.array(name)).alias("names"))

    named = rows.withColumn("names", F.aggregate("s", start, step)["names"])
    below = "array<struct<indent:int,line:int>>"

    def back(state: Column, s: Column) -> Column:
        open_ = F.filter(state["open"], lambda o: o["indent"] <= s["indent"])
        end = F.when(F.size(open_) > 0, F.element_at(open_, -1)["line"] - 1)
        return F.struct(F.concat(open_, F.array(F.struct(s["indent"].alias("indent"), s["line_no"].alias("line")))).cast(below).alias("open"), F.concat(state["ends"], F.array(end)).alias("ends"))

    ends = F.aggregate(F.reverse("s"), F.struct(F.array().cast(below).alias("open"), F.array().cast("array<int>").alias("ends")), back)["ends"]
    placed = named.withColumn("ends", F.reverse(ends)).select(*keys, F.explode(F.arrays_zip("s", "names", "ends")).alias("z"))
    out = placed.select(*keys, "z.s.*", F.col("z.names").alias("_name"), F.col("z.ends").alias("line_end")).drop("qualified_name").withColumnRenamed("_name", "qualified_name")
    return out.select("*", *[F.col("rest")[c].alias(c) for c in rest]).drop("rest")


#: The file that tells a project's stack, most telling first.
STACKS = [("elixir", ["mix.exs"]), ("rust", ["Cargo.toml"]), ("go", ["go.mod"]), ("python", ["pyproject.toml", "setup.py"]), ("node", ["package.json"]), ("java", ["pom.xml", "build.gradle"]), ("dart", ["pubspec.yaml"]), ("ruby", ["Gemfile"]), ("php", ["composer.json"])]


def stacks(files: DataFrame) -> DataFrame:
    """(project_id, primary_stack, all_stacks) by the marker files at each project's root; the second of a stack's markers counts for the primary stack only."""
    rank = F.coalesce(*[F.when(F.col("path").isin(*names), F.struct(F.lit(i).alias("i"), F.lit(s).alias("s"))) for i, (s, names) in enumerate(STACKS)])
    main = F.when(F.col("path").isin(*[names[0] for _, names in STACKS]), F.col("m"))  # other markers tell the primary stack only
    grouped = files.select("project_id", "path", rank.alias("m")).groupBy("project_id").agg(F.array_sort(F.collect_set("m")).alias("m"), F.collect_set(main).alias("all"))
    unknown = F.array(F.lit("unknown"))
    first = F.when(F.size("m") > 0, F.get(F.col("m"), F.lit(0))["s"]).otherwise(F.lit("unknown"))
    every = F.transform(F.array_sort("all"), lambda x: x["s"])
    return grouped.select("project_id", first.alias("primary_stack"), F.when(F.size(every) > 0, every).otherwise(unknown).alias("all_stacks"))


def gitignore_folders(lines: DataFrame) -> DataFrame:
    """(folder): the folder names a .gitignore (lines in column value) excludes: comments, blanks and bare globs are left out, marks and slashes stripped, the first part taken."""
    value = F.trim("value")
    kept = lines.filter((value != "") & ~value.startswith("#") & ~value.startswith("!")).filter(~(F.contains(value, F.lit("*")) & ~F.contains(value, F.lit("/"))))
    bare = F.regexp_replace(F.regexp_replace(value, r"^(\*\*/)+", ""), r"^/+|/+$", "")
    return kept.select(F.get(F.split(bare, "/"), F.lit(0)).alias("folder")).filter((F.col("folder") != "") & ~F.contains("folder", F.lit("*"))).distinct()


def parse(files: DataFrame, text: str = "content", provider: Callable[[str, str], list[dict] | None] | None = None) -> DataFrame:
    """(path, language, line_no, line_end, kind, name, qualified_name, visibility, metadata) of source files (path unique, content).

    YAML goes by its type, all else by line rules, with the containers that
    symbols stand in; binary files give nothing. A file of over 50 bytes in
    which the rules find nothing is read by the fallback rules. ``provider``
    may parse a file better: called with (language, text) in Arrow batches, it
    gives dictionaries (line_no, line_end, kind, name, qualified_name,
    visibility), or None or nothing to leave the file to the rules.
    """
    typed = files.select("path", F.col(text).alias("content"), language(F.col("path")).alias("language")).filter(~binary(F.col("path")))
    yaml = extension(F.col("path")).isin(".yaml", ".yml")
    code, columns = typed.filter(~yaml), ["path", "language", "line_no", "line_end", "kind", "name", "qualified_name", "visibility", "metadata"]
    given = _provided(code, provider) if provider else None
    if given is not None:
        code = code.join(given.select("path").distinct(), "path", "left_anti")
    found = line_symbols(code, keep_line=True)
    missed = code.filter(F.octet_length("content") > 50).join(found.select("path").distinct(), "path", "left_anti")
    found = found.unionByName(line_symbols(missed, "generic", keep_line=True))
    indent = F.length("line") - F.length(F.ltrim(F.replace("line", F.lit("\t"), F.lit("    "))))
    told = found.withColumns({"indent": F.greatest(indent, F.lit(0)), "metadata": line_metadata(F.col("language"), F.col("kind"), F.col("name"), F.col("line"))}).drop("line")
    told = told.withColumn("metadata", F.to_json("metadata"))  # maps cannot be sorted
    out = nested(told, ["path"]).withColumn("metadata", F.from_json("metadata", "map<string,string>")).select(columns)
    if given is not None:
        out = out.unionByName(given.select(columns))
    config = yaml_symbols(typed.filter(yaml)).select("path", F.lit("config").alias("language"), "line_no", F.lit(None).cast("int").alias("line_end"), "kind", "name", "qualified_name", F.lit("public").alias("visibility"), F.create_map().cast("map<string,string>").alias("metadata"))
    return out.unionByName(config)


def _provided(files: DataFrame, provider: Callable[[str, str], list[dict] | None]) -> DataFrame:
    names = ["line_no", "line_end", "kind", "name", "qualified_name", "visibility"]
    kinds = [pa.int32(), pa.int32(), *[pa.string()] * 4]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, (lang, content) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for row in provider(lang, content or "") or ():
                    at.append(i)
                    rows.append(row)
            took = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([took.column(0), took.column(1), *[pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)]], names=["path", "language", *names])

    found = files.select("path", "language", "content").mapInArrow(ask, "path string, language string, line_no int, line_end int, kind string, name string, qualified_name string, visibility string")
    return found.withColumn("metadata", F.create_map().cast("map<string,string>"))


#: A project's framework by its marker file and a text in it; the first that fits.
PROJECT_FRAMEWORKS: list[tuple[str, list[str], str | None]] = [
    ("Elixir/Phoenix", ["mix.exs"], ":phoenix"), ("Elixir/Nerves (embedded)", ["mix.exs"], ":nerves"), ("Elixir/Broadway (data pipelines)", ["mix.exs"], ":broadway"), ("Elixir/OTP", ["mix.exs"], None),
    ("TypeScript/Next.js", ["package.json"], '"next"'), ("TypeScript/Nuxt.js", ["package.json"], '"nuxt"'), ("TypeScript/Angular", ["package.json"], '"@angular/core"'), ("TypeScript/React", ["package.json"], '"react"'),
    ("TypeScript/Vue", ["package.json"], '"vue"'), ("TypeScript/NestJS", ["package.json"], '"@nestjs/core"'), ("Node.js/Express", ["package.json"], '"express"'), ("Node.js/TypeScript", ["package.json"], None),
    ("Rust", ["Cargo.toml"], None), ("Go", ["go.mod"], None), ("Java/Maven", ["pom.xml"], None), ("Kotlin/Gradle or Java/Gradle", ["build.gradle", "build.gradle.kts"], None), ("Dart/Flutter", ["pubspec.yaml"], None),
    ("Python/Django", ["pyproject.toml", "requirements.txt"], "django"), ("Python/FastAPI", ["pyproject.toml", "requirements.txt"], "fastapi"), ("Python/Flask", ["pyproject.toml", "requirements.txt"], "flask"),
    ("Python/ML (PyTorch/TF)", ["pyproject.toml", "requirements.txt"], "torch"), ("Python/ML (PyTorch/TF)", ["pyproject.toml", "requirements.txt"], "tensorflow"), ("Python", ["pyproject.toml", "requirements.txt"], None),
    ("Ruby on Rails", ["Gemfile"], "rails"), ("Ruby", ["Gemfile"], None), ("PHP/Laravel or Symfony", ["composer.json"], None),
]


def project_frameworks(files: DataFrame) -> DataFrame:
    """(project_id, framework) by the marker files (project_id, path, content) at each project's root; projects without one give no row."""
    found = [F.when(F.col("path").isin(*names) & (F.lit(True) if text is None else F.contains(F.coalesce("content", F.lit("")), F.lit(text))), F.struct(F.lit(i).alias("i"), F.lit(name).alias("name"))) for i, (name, names, text) in enumerate(PROJECT_FRAMEWORKS)]
    best = files.select("project_id", F.coalesce(*found).alias("f")).filter("f is not null").groupBy("project_id").agg(F.min("f").alias("f"))
    return best.select("project_id", F.col("f.name").alias("framework"))
