"""Source-tree mining over ``repo, path, content`` rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline import lexicons as lx


def read_repo_files(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """All files below ``root/<repo>/``, one row per file.

    Only files that the operators read have their content, whole: source suffixes,
    build files, configuration and READMEs, of any length unless ``max_bytes`` is given;
    names and length are checked by the scan, before a byte is read. One of 2 GB or more
    is an error, as Spark cannot hold it in a row. Bytes that are no UTF-8 become
    replacement characters. The other files have a null content.
    """
    base = root.rstrip("/")
    rel = F.regexp_extract("path", r"\Q" + base.lstrip("/") + r"\E/(.*)$", 1)
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    names = [*lx.BUILD_FILES, *lx.ENTRY_FILES, *lx.README_NAMES, "*.yml", "*.yaml", "*.properties"]
    wanted = "{" + ",".join(dict.fromkeys([f"*{x}" for x in lx.SOURCE_SUFFIXES] + names)) + "}"
    texts = scan.option("pathGlobFilter", wanted).load(base)
    if max_bytes is not None:
        texts = texts.filter(F.col("length") <= max_bytes)
    texts = texts.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    return every.select("path", "length").join(texts, "path", "left").select(
        F.split_part(rel, F.lit("/"), F.lit(1)).alias("repo"),
        F.regexp_extract(rel, r"^[^/]+/(.*)$", 1).alias("path"),
        "length",
        "content",
    )


def _name() -> Column:
    return F.regexp_extract("path", r"[^/]+$", 0)


def _suffix() -> Column:
    return F.lower(F.regexp_extract(_name(), r"[^.](\.[^.]+)$", 1))


def _top_dir() -> Column:
    return F.when(F.col("path").contains("/"), F.split_part("path", F.lit("/"), F.lit(1)))


def visible(files: DataFrame, ignored: Sequence[str] = lx.IGNORED_DIRS) -> DataFrame:
    """Files outside hidden and ignored folders."""
    hidden = F.exists(F.split("path", "/"), lambda p: p.startswith(".") | p.isin(list(ignored)))
    return files.filter(~hidden)


def mine_stack(files: DataFrame) -> DataFrame:
    """Build files at the root of a repository and what they stand for."""
    table = F.create_map(*[F.lit(x) for pair in lx.BUILD_FILES.items() for x in pair])
    return files.filter(F.col("path").isin(list(lx.BUILD_FILES))).select(
        "repo", F.col("path").alias("build_file"), F.element_at(table, F.col("path")).alias("stack")
    )


def files_per_suffix(files: DataFrame) -> DataFrame:
    sources = visible(files).withColumn("suffix", _suffix()).filter(F.col("suffix").isin(lx.SOURCE_SUFFIXES))
    return sources.groupBy("repo", "suffix").agg(F.count("*").alias("n_files"))


def language_breakdown(files: DataFrame, limit: int = 8) -> DataFrame:
    """The most frequent suffixes per repository."""
    order = Window.partitionBy("repo").orderBy(F.desc("n_files"), "suffix")
    return files_per_suffix(files).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def files_per_top_dir(files: DataFrame) -> DataFrame:
    """Source files per top folder; folders without any count zero."""
    rows = visible(files).withColumn("top_dir", _top_dir()).filter(F.col("top_dir").isNotNull())
    return rows.groupBy("repo", "top_dir").agg(
        F.count_if(_suffix().isin(lx.SOURCE_SUFFIXES)).alias("n_files")
    )


def structural_map(files: DataFrame, dirs: int = 20, languages: int = 8) -> DataFrame:
    """Per repository: files, first folders by name, main suffixes, entry files."""
    noise = ["node_modules", "build", "dist", "__pycache__"]
    seen = visible(files, noise)
    counted = seen.groupBy("repo").agg(F.count("*").alias("n_files"))
    tops = files.select("repo", _top_dir().alias("d")).filter(
        F.col("d").isNotNull() & ~F.col("d").startswith(".")
    ).distinct()
    names = Window.partitionBy("repo").orderBy("d")
    top_dirs = (
        tops.withColumn("i", F.row_number().over(names)).filter(F.col("i") <= dirs)
        .groupBy("repo").agg(F.array_sort(F.collect_list("d")).alias("top_dirs"))
    )
    by_suffix = seen.withColumn("s", _suffix()).filter(F.col("s") != "").groupBy("repo", "s").agg(F.count("*").alias("n"))
    busiest = Window.partitionBy("repo").orderBy(F.desc("n"), "s")
    langs = (
        by_suffix.withColumn("i", F.row_number().over(busiest)).filter(F.col("i") <= languages)
        .groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("i", "s", "n"))).alias("l"))
        .select("repo", F.transform("l", lambda x: F.struct(x["s"].alias("suffix"), x["n"].alias("n_files"))).alias("languages"))
    )
    entries = files.filter(F.col("path").isin(lx.ENTRY_FILES)).groupBy("repo").agg(
        F.array_sort(F.collect_set("path")).alias("entry_points")
    )
    return counted.join(top_dirs, "repo", "left").join(langs, "repo", "left").join(entries, "repo", "left")


# --- symbols --------------------------------------------------------------------------

_JAVA_KINDS = [
    ("services", r"Service\.java$"),
    ("exceptions", r"Exception\.java$"),
    ("endpoints", r"(Controller|Handler|Endpoint|Resource)\.java$"),
]
_DTO = r"(Dto|DTO|Request|Response)\.java$"


def _by_line(files: DataFrame, suffix: str, pattern: str, groups: int) -> DataFrame:
    """First match of ``pattern`` in every line of the files with ``suffix``."""
    lines = visible(files).filter(F.col("path").endswith(suffix)).select(
        "repo", _top_dir().alias("top_dir"), F.explode(F.split("content", "\n")).alias("line")
    )
    hit = lines.filter(F.col("line").rlike(pattern))
    return hit.select(
        "repo", "top_dir", "line", *[F.regexp_extract("line", pattern, g).alias(f"g{g}") for g in range(1, groups + 1)]
    )


def distinct_symbols(symbols: DataFrame, limit: int = lx.SYMBOL_LIMIT) -> DataFrame:
    """``repo, top_dir, kind, name``: totals, and the first names in order.

    Names are made distinct by a shuffle and ranked before anything is
    collected, so an array never holds more than ``limit`` names.
    """
    unique = symbols.distinct()
    groups = ["repo", "top_dir", "kind"]
    order = Window.partitionBy(*groups).orderBy("name")
    first = (
        unique.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= limit)
        .groupBy(*groups).agg(F.array_sort(F.collect_list("name")).alias("names"))
    )
    return unique.groupBy(*groups).agg(F.count("*").alias("total")).join(first, groups)


def java_symbols(files: DataFrame) -> DataFrame:
    """Class names by kind from file names, and enum names from the text."""
    java = visible(files).filter(F.col("path").endswith(".java") & F.col("path").contains("/"))
    stem = F.regexp_replace(_name(), r"\.java$", "")
    kinds = F.array_compact(F.array(*[F.when(F.col("path").rlike(p), F.lit(k)) for k, p in _JAVA_KINDS]))
    named = java.select("repo", _top_dir().alias("top_dir"), F.explode(kinds).alias("kind"), stem.alias("name"))
    enums = _by_line(files, ".java", r"public\s+enum\s+(\w+)", 1).filter(F.col("top_dir").isNotNull()).select(
        "repo", "top_dir", F.lit("enums").alias("kind"), F.col("g1").alias("name")
    )
    return named.unionByName(enums)


def mine_java_symbols(files: DataFrame, limit: int = lx.SYMBOL_LIMIT) -> DataFrame:
    return distinct_symbols(java_symbols(files), limit)


def java_contracts(files: DataFrame) -> DataFrame:
    """Number of data contract classes per top folder."""
    return (
        visible(files).filter(F.col("path").rlike(_DTO) & F.col("path").contains("/"))
        .groupBy("repo", _top_dir().alias("top_dir")).agg(F.count("*").alias("dto_count"))
    )


def mine_spring_routes(files: DataFrame) -> DataFrame:
    """Distinct (verb, path) of mapping annotations."""
    pattern = r"""@(Get|Post|Put|Delete|Patch|Request)Mapping\s*\(\s*(?:value\s*=\s*)?["']([^"']+)["']"""
    return (
        _by_line(files, ".java", pattern, 2)
        .select("repo", F.upper("g1").alias("verb"), F.trim("g2").alias("route"))
        .filter(F.col("route") != "").distinct()
    )


def mine_python_routes(files: DataFrame) -> DataFrame:
    """Distinct (verb, path) of route decorators; a bare route serves any verb."""
    pattern = r"""@\w+\.(route|get|post|put|delete|patch)\s*\(\s*["']([^"']+)["']"""
    verb = F.when(F.col("g1") == "route", "ANY").otherwise(F.upper("g1"))
    return _by_line(files, ".py", pattern, 2).select("repo", verb.alias("verb"), F.trim("g2").alias("route")).distinct()


def python_symbols(files: DataFrame) -> DataFrame:
    """Classes and exceptions; a name that is anywhere an exception is no class."""
    rows = _by_line(files, ".py", r"^class\s+(\w+)", 1).filter(F.col("top_dir").isNotNull())
    error = F.col("line").rlike(r"^class\s+\w*(?:Exception|Error)\s*[\(:]")
    return rows.groupBy("repo", "top_dir", F.col("g1").alias("name")).agg(
        F.when(F.bool_or(error), "exceptions").otherwise("classes").alias("kind")
    ).select("repo", "top_dir", "kind", "name")


def mine_python_classes(files: DataFrame, limit: int = lx.SYMBOL_LIMIT) -> DataFrame:
    return distinct_symbols(python_symbols(files), limit)


def mine_config_files(files: DataFrame) -> DataFrame:
    wanted = _name().rlike(r"^application(-.*)?\.(yml|yaml|properties)$")
    return visible(files).filter(wanted).select("repo", "path").distinct()


def mine_grep(files: DataFrame, query: str, per_file: int = 5, total: int = 20) -> DataFrame:
    """Lines holding ``query`` in any case: the first few per file, a capped list per repository."""
    lines = files.select("repo", "path", F.posexplode(F.split("content", "\n")).alias("pos", "text"))
    hits = lines.filter(F.lower("text").contains(query.lower())).withColumn("line_no", F.col("pos") + 1)
    in_file = Window.partitionBy("repo", "path").orderBy("line_no")
    in_repo = Window.partitionBy("repo").orderBy("path", "line_no")
    return (
        hits.withColumn("i", F.row_number().over(in_file)).filter(F.col("i") <= per_file)
        .withColumn("n", F.row_number().over(in_repo)).filter(F.col("n") <= total)
        .select("repo", "path", "line_no", "text")
    )


def recent_n(commits: DataFrame, n: int = 15, group: str = "repo", order: str = "date", tie: str = "id") -> DataFrame:
    newest = Window.partitionBy(group).orderBy(F.desc(order), tie)
    return commits.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= n)


def readme(files: DataFrame, chars: int = 3500) -> DataFrame:
    """The README of a repository, by preference of file name; an excerpt of it."""
    order = F.array_position(F.array(*[F.lit(n) for n in lx.README_NAMES]), F.col("path"))
    body = F.trim(F.left("content", F.lit(chars)))
    excerpt = F.when(F.length("content") > chars, F.concat(body, F.lit("\n\n... (truncated)"))).otherwise(body)
    return files.filter(F.col("path").isin(lx.README_NAMES)).groupBy("repo").agg(
        F.min_by(excerpt, order).alias("readme_excerpt")
    )


def repo_summary(
    files: DataFrame, manifest: DataFrame, commits: DataFrame | None = None, limit: int = lx.SYMBOL_LIMIT,
    dirs: int = 15, routes: int = 40, configs: int = 15, recent: int = 15,
) -> DataFrame:
    """One nested row per repository of the manifest.

    Every list is capped before it is collected and has its total beside it; routes
    are listed by kind, symbols for the folders listed. ``commits(repo, id, date,
    summary)`` adds the newest ones.
    """

    def capped(rows: DataFrame, order: list, n: int, entry: Column, name: str) -> DataFrame:
        w = Window.partitionBy("repo").orderBy(*order)
        picked = rows.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= n)
        grouped = picked.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("_i", entry.alias("e")))).alias("a"))
        return grouped.select("repo", F.transform("a", lambda x: x["e"]).alias(name))

    symbols = mine_java_symbols(files, limit).unionByName(mine_python_classes(files, limit))
    symbol = F.struct("top_dir", "kind", "total", "names")
    modules = files_per_top_dir(files)
    busiest = Window.partitionBy("repo").orderBy(F.desc("n_files"), "top_dir")
    listed = modules.withColumn("_i", F.row_number().over(busiest)).filter(F.col("_i") <= dirs)
    symbols = symbols.join(listed.select("repo", "top_dir"), ["repo", "top_dir"])
    contracts = java_contracts(files).join(listed.select("repo", "top_dir"), ["repo", "top_dir"])

    def routed(rows: DataFrame, kind: str) -> list[DataFrame]:
        count = rows.groupBy("repo").agg(F.count("*").alias(f"n_{kind}_routes"))
        first = capped(rows, ["route", "verb"], routes, F.struct("verb", "route"), f"{kind}_routes")
        return [count, first]

    parts = [
        *routed(mine_spring_routes(files), "spring"),
        *routed(mine_python_routes(files), "python"),
        modules.groupBy("repo").agg(F.count("*").alias("n_modules")),
        contracts.groupBy("repo").agg(
            F.array_sort(F.collect_list(F.struct("top_dir", "dto_count"))).alias("contracts")
        ),
        files_per_suffix(files).groupBy("repo").agg(F.sum("n_files").alias("n_source_files")),
        capped(mine_stack(files), ["build_file"], len(lx.BUILD_FILES), F.struct("build_file", "stack"), "stack_files"),
        capped(language_breakdown(files).drop("place"), [F.desc("n_files"), "suffix"], 8, F.struct("suffix", "n_files"), "languages"),
        capped(files_per_top_dir(files), [F.desc("n_files"), "top_dir"], dirs, F.struct("top_dir", "n_files"), "modules"),
        capped(symbols, ["top_dir", "kind"], dirs * 6, symbol, "symbols"),  # six kinds at most
        capped(mine_config_files(files), ["path"], configs, F.col("path"), "config_files"),
        readme(files),
    ]
    if commits is not None:
        entry = F.struct("id", "date", "summary")
        parts.append(capped(recent_n(commits, recent), ["place"], recent, entry, "commits"))
    out = manifest.withColumnRenamed("name", "repo")
    for part in parts:
        out = out.join(part, "repo", "left")
    return out
