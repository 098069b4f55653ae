"""Text generation around an injected client: prompts as columns, calls in batches with retries, and what is read back from answers."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions.files import is_noise, truncated
from codequarry.operators import prompts
from codequarry.session import durable

#: Takes a prompt, returns the answer; raises to be tried again.
Client = Callable[[str], str]

# Suffixes of files that an answer may ask for, words that introduce one, and signatures by language.
CODE_SUFFIXES = "java|py|ts|js|tsx|jsx|go|rs|c|cpp|h|hpp|cs|rb|php|swift|kt|scala|lua|dart|vue|svelte|sql|sh|bash"
ASKING = r"(?:show|see|look\s*(?:at|into)|read|examine|review|check|could\s+you|can\s+you|please|帮我|我想看|请给我|查看|看看)"
SIGNATURES = {
    "java": (
        r"(?:(?:public|private|protected|abstract|final)\s+)?(?:class|interface|enum)\s+\w+",
        r"(?:public|private|protected)\s+(?:static\s+)?(?:\w+\s)+(?!get|set|is)\w+\s*\([^)]*\)"
    ),
    "python": (r"(?m)^(?:async\s+)?def\s+\w+\s*\([^)]*\)", r"(?m)^class\s+\w+"),
    "javascript": (r"function\s+\w+|const\s+\w+\s*=|\w+\s*\([^)]*\)\s*\{",),
    "typescript": (r"function\s+\w+|const\s+\w+\s*=|\w+\s*\([^)]*\)\s*\{",),
    "go": (r"func\s+\w+\s*\([^)]*\)",),
}


def offline(prompt: str) -> str:
    """Deterministic stand-in for a client: the prompt's first line as a heading."""
    return f"# {prompt.strip().splitlines()[0][:80] if prompt.strip() else 'Empty'}\n"


def complete(prompts: DataFrame, client: Client = offline, tries: int = 3, pause: float = 1.0, concurrency: int = 5) -> DataFrame:
    """id, answer, status, error for prompts(id, prompt). Calls run in `concurrency` tasks; a call that raises is tried again after a pause
    that doubles, and one that keeps failing is `failed`, not an answer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, prompt in zip(pdf["id"], pdf["prompt"]):
                answer, error = None, None
                for turn in range(tries):
                    try:
                        answer, error = client(prompt or ""), None
                        break
                    except Exception as e:  # noqa: BLE001  any failure of the service counts
                        error = str(e)[:500]
                        time.sleep(pause * 2**turn if turn + 1 < tries else 0)
                rows.append((key, answer, "success" if error is None else "failed", error))
            yield pd.DataFrame(rows, columns=["id", "answer", "status", "error"])

    return prompts.select("id", "prompt").repartition(concurrency).mapInPandas(run, "id string, answer string, status string, error string")


def find_json(text: str) -> object | None:
    """The first JSON object or array in an answer: as it stands, in a fence, or from the first bracket to its partner."""
    for piece in (text, *re.findall(r"```(?:json)?\s*\n(.*?)```", text, re.DOTALL)):
        try:
            return json.loads(piece)
        except ValueError:
            continue
    decoder = json.JSONDecoder()
    for m in re.finditer(r"[\[{]", text):
        try:
            return decoder.raw_decode(text, m.start())[0]
        except ValueError:
            continue
    return None


def json_answers(answers: DataFrame, schema: str) -> DataFrame:
    """id and the fields of schema that the JSON in each answer has; unknown fields are dropped, missing ones null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [find_json(a) if a else None for a in pdf["answer"]]
            yield pd.DataFrame({"id": pdf["id"], "doc": [json.dumps(x) if x is not None else None for x in found]})

    return answers.select("id", "answer").mapInPandas(run, "id string, doc string").select("id", F.from_json("doc", schema).alias("f")).select("id", "f.*")


def requested_files(text: Column) -> Column:
    """Paths that an answer asks for, in order, once each: lines of its section of needed files, paths behind asking words, and then
    all that stand alone."""
    path = rf"[a-zA-Z0-9_\-/.\\]+\.(?:{CODE_SUFFIXES})"
    section = F.regexp_extract(text, r"(?is)## Files I Need\s*\n(.*?)(?:\n##|\z)", 1)
    listed = F.regexp_extract_all(section, F.lit(rf"(?im)^\s*(?:[-*•]\s*)?(?:\*\*)?({path})(?:\*\*)?\s*$"), F.lit(1))
    asked = F.regexp_extract_all(text, F.lit(rf"(?i){ASKING}\s+(?:me\s+)?(?:the\s+)?(?:content\s+(?:of|for)\s+)?({path})"), F.lit(1))
    alone = F.regexp_extract_all(text, F.lit(rf"(?<![a-zA-Z0-9_\-/.])({path})(?![a-zA-Z0-9_\-/.\\])"), F.lit(1))
    clean = F.transform(F.concat(listed, asked, alone), lambda p: F.translate(p, "\\", "/"))
    return F.array_distinct(F.filter(clean, lambda p: p.rlike(r"^[a-zA-Z0-9_\-/.]+\.[a-zA-Z]+$")))


def signatures(files: DataFrame, most: int = 20) -> DataFrame:
    """path, signatures: the first `most` declarations of files(path, language, content), classes before methods."""
    found = F.array().cast("array<string>")
    for language, patterns in SIGNATURES.items():
        every = F.concat(*(F.regexp_extract_all("content", F.lit(p), F.lit(0)) for p in patterns))
        found = F.when(F.col("language") == language, every).otherwise(found)
    return files.select("path", F.slice(found, 1, most).alias("signatures")).where(F.size("signatures") > 0)


def project_type(files: DataFrame) -> DataFrame:
    """project_type: one row, by which markers files(path, language, content, is_config) have; the first of the ladder that fits."""
    p = F.col("path")
    ui = p.startswith("src/") & p.rlike(r"\.(tsx|jsx|vue|svelte)")
    front = p.isin("package.json", "tsconfig.json", "vite.config.ts", "webpack.config.js") | ui
    back = p.isin(
        "requirements.txt", "pyproject.toml", "setup.py", "Gemfile", "go.mod", "Cargo.toml"
    ) | p.contains("app.py") | p.contains("server.py") | (p.startswith("src/") & F.col("language").isin("python", "go", "rust"))
    cli = p.isin("setup.py", "pyproject.toml") & F.col("content").rlike("console_scripts|entry_points|scripts")
    mono = p.contains("packages/") | p.contains("workspace") | F.lower(p).contains("monorepo")
    code = F.col("language").isin("python", "rust", "go") & ~F.col("is_config")
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    marks = files.agg(any_of(front).alias("front"), any_of(back).alias("back"), any_of(cli).alias("cli"), any_of(mono).alias("mono"), F.count_if(code).alias("code"))
    kind = F.when(F.col("mono"), "monorepo").when(
        F.col("front") & F.col("back"), "full-stack"
    ).when(F.col("front"), "frontend-app").when(F.col("back"), "backend-app").when(F.col("cli"), "cli-tool").when(F.col("code") > 5, "library")
    return marks.select(kind.otherwise("unknown").alias("project_type"))


def module_prompts(files: DataFrame, module_of: Callable[[Column], Column], most_files: int = 20, most_chars: int = 2048) -> DataFrame:
    """id (the module), prompt, memo, n_files: a prompt for each module of files(path, content) over its first files by path, and the key under
    which an answer is kept, which changes with any of the module's contents. Only the files that are shown are gathered; the others
    enter by a sum of hashes."""
    own = files.select(
        module_of(F.col("path")).alias("id"), "path", truncated(F.col("content"), most_chars).alias("shown"),
        F.xxhash64("path", F.md5("content")).alias("h")
    )
    keys = own.groupBy("id").agg(F.bit_xor("h").alias("h"), F.count("*").alias("n_files"))
    first = own.withColumn("at", F.row_number().over(Window.partitionBy("id").orderBy("path"))).where(F.col("at") <= most_files)
    parts = first.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("path", "shown"))).alias("parts"))
    body = F.array_join(F.transform("parts", lambda x: F.concat(F.lit("--- "), x["path"], F.lit("\n"), x["shown"])), "\n\n")
    memo = F.substring(F.sha2(F.concat_ws("\n", "id", F.col("h").cast("string"), F.col("n_files").cast("string")), 256), 1, 24)
    return parts.join(keys, "id").select("id", prompts.module(F.col("id"), body).alias("prompt"), memo.alias("memo"), "n_files")


def wanted_files(answers: DataFrame, known: DataFrame, given: DataFrame, most: int = 10) -> DataFrame:
    """id, path: the first `most` files of known(path) that each of answers(id, answer) asks for and that given(id, path) has not got."""
    asked = answers.select("id", F.posexplode(requested_files(F.col("answer"))).alias("at", "path"))
    new = asked.join(known.select("path").distinct(), "path", "left_semi").join(given.select("id", "path"), ["id", "path"], "left_anti")
    ranked = new.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("at")))
    return ranked.where(F.col("n") <= most).select("id", "path")


def explore(prompts_: DataFrame, files: DataFrame, client: Client, turns: int = 5, concurrency: int = 5) -> DataFrame:
    """id, answer, turns for prompts(id, prompt): each is asked; an answer that wants files of files(path, content) gets them and is asked
    again, up to `turns` times; the first answer that wants none, or the last, counts. A turn is one call for all that are still open."""
    open_, given, done = prompts_.select("id", "prompt"), None, None
    for turn in range(1, turns + 1):
        said = durable(complete(open_, client, concurrency=concurrency).join(open_, "id"))
        have = given if given is not None else said.select("id", F.lit("").alias("path"))
        wants = durable(wanted_files(said.where("status = 'success'"), files, have))
        last = said if turn == turns else said.join(wants.select("id").distinct(), "id", "left_anti")
        result = last.select("id", "answer", "status", F.lit(turn).alias("turns"))
        done = result if done is None else done.union(result)
        if turn == turns or wants.isEmpty():
            break
        shown = F.concat(F.lit("### "), "path", F.lit("\n"), truncated(F.col("content"), 4096))
        more = wants.join(files.select("path", "content"), "path").groupBy("id").agg(F.array_join(F.sort_array(F.collect_list(shown)), "\n\n").alias("more"))
        open_ = durable(said.join(more, "id").select("id", F.concat_ws("\n\n", "prompt", "answer", "more").alias("prompt")))
        given = wants if given is None else given.union(wants)
    return done


def chosen_files(files: DataFrame, most: int = 20) -> DataFrame:
    """The files of a module that are worth reading first: none that hold only data, the largest first."""
    return files.where(~is_noise(F.col("path"))).orderBy(F.col("size").desc(), "path").limit(most)


def uncached(prompts: DataFrame, cache: DataFrame) -> DataFrame:
    """Prompts whose memo has no answer in cache(memo, answer)."""
    return prompts.join(cache.select("memo"), "memo", "left_anti")


def pattern_document(patterns: DataFrame) -> DataFrame:
    """content: what stands for a generated architecture document where there is no client, from recognised patterns in order."""
    line = F.concat(F.lit("## "), F.col("pattern"), F.lit("\n"), F.col("description"), F.lit("\nConfidence: "), F.format_number("confidence", 2))
    rows = patterns.agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("k"), "pattern", line.alias("line")))).alias("a"))
    return rows.select(F.concat(F.lit("# Architecture\n\n"), F.array_join(F.transform("a", lambda x: x["line"]), "\n\n")).alias("content"))
