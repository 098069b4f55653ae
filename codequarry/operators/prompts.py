"""Prompts for an injected client, as text columns. Each asks for one thing and, where the answer is read back, names the fields of its
JSON, which are those of the schemas in pages.py."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codequarry.operators import pages
from codequarry.operators.pages import labels, lines


def _asked(task: str, language: str, *parts: tuple[str, Column | str], fields: str | None = None) -> Column:
    """A task, the parts it rests on under their headings, the fields of the answer if it is JSON, and the language to answer in."""
    out: list[Column] = [F.lit(f"## Task\n{task}")]
    for title, body in parts:
        out.append(F.concat(F.lit(f"## {title}\n"), F.lit(body) if isinstance(body, str) else F.coalesce(body, F.lit("None"))))
    if fields:
        names = ", ".join(f.split(" ")[0] for f in fields.split(", "))
        out.append(F.lit(f"## Answer\nOne JSON object with the fields {names}."))
    out.append(F.lit(labels(language)["respond"]))
    return F.concat_ws("\n\n", *out)


def overview(tree: Column, key_files: Column, language: str = "en") -> Column:
    return _asked(
        "Describe this project: its purpose, kind, entry points, technologies, features and first steps.", language, ("File tree", tree),
        ("Key files", key_files), fields=pages.OVERVIEW
    )


def architecture(tree: Column, dependencies: Column, summaries: Column, language: str = "en") -> Column:
    return _asked(
        "Describe the architecture: its type, components with their files, and how data flows. Draw components and a typical sequence in Mermaid.",
        language, ("File tree", tree), ("Module dependencies", dependencies), ("Modules", summaries), fields=pages.ARCHITECTURE
    )


def reading_guide(tree: Column, core: Column, summaries: Column, language: str = "en") -> Column:
    return _asked(
        "Write a guide to reading this project: steps in order with their files, why they come then, and how long they take.", language,
        ("File tree", tree), ("Most important files", core), ("Modules", summaries), fields=pages.GUIDE
    )


def module(name: Column, files: Column, language: str = "en") -> Column:
    return _asked(
        "Document this module: its purpose, its files with their main symbols, how they work together, and its concepts.", language,
        ("Module", name), ("Files", files), fields=pages.MODULE
    )


def chat(question: Column, context: Column, language: str = "en") -> Column:
    return _asked(
        "Answer the question from the quoted parts of the project, and name the files you rely on.", language, ("Quoted parts", context),
        ("Question", question)
    )


def document_map(summary: Column, language: str = "en") -> Column:
    fields = "categories array, docs array"
    rules = "Categories have id, title, description, parent_id, order. Docs have id, title, category_id, purpose, related_file_patterns, depends_on, order."
    return _asked("Plan the documents of this project as a tree of categories.", language, ("Structure", summary), ("Rules", rules), fields=fields)


def document(title: Column, purpose: Column, files: Column, dependencies: Column, language: str = "en") -> Column:
    words = labels(language)
    rules = f"Begin with the files you rest on ({words['cited']}) and a table of contents ({words['toc']}); put sources under sections ({words['section']}) and diagrams ({words['diagram']})."
    return _asked("Write this document in Markdown.", language, ("Title", title), ("Purpose", purpose), ("Files", files), ("Dependencies", dependencies), ("Form", rules))


def category_index(title: Column, description: Column, docs: Column, language: str = "en") -> Column:
    """docs is an array of (title, purpose)."""
    children = lines(docs, lambda d: F.concat(F.lit("- **"), d["title"], F.lit("**: "), d["purpose"]))
    return _asked("Introduce this category in two or three sentences.", language, ("Category", F.concat_ws("\n", title, description)), ("Documents", children))


def exploration(name: Column, project: Column, signatures: Column, cross: Column, language: str = "en") -> Column:
    """First prompt of an exploration: an answer may ask for files under `## Files I Need`, or be the module's JSON."""
    rules = "Ask for files you need in full, a path a line, under the heading `## Files I Need`. When you know enough, answer with the JSON alone."
    return _asked(
        "Explore and document this module.", language, ("Module", name), ("Project", project), ("Signatures", signatures),
        ("Files of other modules", cross), ("Rules", rules), fields=pages.MODULE
    )


def structure_summary(tree: Column, dependencies: Column, core: Column) -> Column:
    """The file tree's first 3000 characters, module dependencies (array of (src_module, targets)) and the first 15 core files (array)."""
    deps = lines(F.sort_array(dependencies), lambda d: F.concat(F.lit("- "), d["src_module"], F.lit(" → "), F.array_join(F.sort_array(d["targets"]), ", ")))
    return F.concat_ws(
        "\n", F.concat(F.lit("File tree:\n"), F.substring(tree, 1, 3000)), F.when(F.size(dependencies) > 0, F.concat(F.lit("\n## Module Dependencies\n"), deps)),
        F.when(F.size(core) > 0, F.concat(F.lit("\n## Top Files by Importance (PageRank)\n"), lines(F.slice(core, 1, 15), lambda f: F.concat(F.lit("- "), f)))),
    )


def files_context(files: Column, most: int = 4096) -> Column:
    """Files (path, language, content) as fenced blocks under their paths, each cut at `most` characters."""
    shown = lambda f: F.when(
        F.length(f["content"]) > most, F.concat(F.substring(f["content"], 1, most), F.lit("\n... (truncated)"))
    ).otherwise(f["content"])
    return F.array_join(F.transform(files, lambda f: F.concat(F.lit("### "), f["path"], F.lit("\n```"), f["language"], F.lit("\n"), shown(f), F.lit("\n```"))), "\n\n")


def referenced(context: Column, most: int = 15) -> Column:
    """Paths that files_context() put in a prompt, the first `most`."""
    heads = F.filter(F.split(context, "\n"), lambda x: x.startswith("### "))
    return F.slice(F.transform(heads, lambda x: F.split_part(F.substring(x, 5, 1 << 20), F.lit(" ("), F.lit(1))), 1, most)
