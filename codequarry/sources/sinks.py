"""Writers of wikis: Markdown folders, JSON, one self-contained page, and the record for the next run."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.operators.metadata import read_document
from codequarry.operators.render import escaped, markdown_to_html
from codequarry.operators.state import changed, merged


#: Files of a wiki beside its pages.
SIDEBAR, RECORD, METADATA = "_sidebar.md", ".generation_record.json", "meta/metadata.json"


def _store(folder: str):  # noqa: ANN202
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_text(text: str, folder: str, name: str) -> None:
    """Write a small file from the driver."""
    store, root = _store(folder)
    path = f"{root}/{name}"
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path) as out:
        out.write(text.encode())


def read_text(folder: str, name: str) -> str | None:
    """Content of a small file, or None if there is none."""
    from pyarrow import fs

    store, root = _store(folder)
    if store.get_file_info(f"{root}/{name}").type != fs.FileType.File:
        return None
    with store.open_input_stream(f"{root}/{name}") as f:
        return f.read().decode()


def clear(folder: str) -> None:
    """Remove the pages and the sidebar of a wiki, before it is written in full."""
    from pyarrow import fs

    store, root = _store(folder)
    if store.get_file_info(f"{root}/content").type == fs.FileType.Directory:
        store.delete_dir(f"{root}/content")
    if store.get_file_info(f"{root}/{SIDEBAR}").type == fs.FileType.File:
        store.delete_file(f"{root}/{SIDEBAR}")


def write_markdown(pages: DataFrame, folder: str, records: DataFrame | None = None) -> DataFrame:
    """Write pages(id, content) as folder/content/{id}.md; with records only those that changed. Returns the new record. Executors
    write their own rows through a file system that pyarrow opens."""
    todo = changed(pages, records) if records is not None else pages

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _store(folder)
        for pdf in batches:
            for name, content in zip(pdf["id"], pdf["content"]):
                path = f"{root}/content/{name}.md"
                store.create_dir(path.rpartition("/")[0], recursive=True)
                with store.open_output_stream(path) as out:
                    out.write(content.encode())
            yield pdf[["id"]]

    todo.select("id", "content").mapInPandas(write, "id string").count()
    return merged(records, pages) if records is not None else pages.select("id", F.md5("content").alias("hash"))


def write_record(record: DataFrame, folder: str) -> None:
    """The record id, hash of a run as one JSON object; an object for every page of a wiki fits the driver."""
    rows = {r.id: {"path": f"content/{r.id}.md", "hash": r.hash} for r in record.select("id", "hash").collect()}
    write_text(json.dumps(rows, indent=2, ensure_ascii=False) + "\n", folder, RECORD)


def read_record(spark: SparkSession, folder: str) -> DataFrame | None:
    """id, hash as the last run wrote them, or None if there is no readable record."""
    try:
        rows = json.loads(read_text(folder, RECORD) or "")
        pairs = [(k, v["hash"]) for k, v in rows.items()]
    except (ValueError, TypeError, KeyError, AttributeError):
        return None
    return spark.createDataFrame(pairs, "id string, hash string")


def export_markdown(pages: DataFrame, sidebar: DataFrame, folder: str, project: str, mode: str = "full", metadata: DataFrame | None = None) -> DataFrame:
    """Write a wiki: its pages, the sidebar(text), the record, and the metadata(json) if there is any. Mode `full` clears the folder first,
    `incremental` writes only pages that differ from the record. Returns the new record."""
    if mode == "full":
        clear(folder)
    records = read_record(pages.sparkSession, folder) if mode == "incremental" else None
    record = write_markdown(pages, folder, records)
    write_text(f"# {project}\n\n{sidebar.first().text}\n", folder, SIDEBAR)
    write_record(record, folder)
    if metadata is not None:
        write_text(metadata.first().json, folder, METADATA)
    return record


def json_document(pages: DataFrame, sidebar: DataFrame, project: str) -> DataFrame:
    """json: one row with the whole wiki: pages(id, title, content, parent_id, ord) in order and the entries of
    sidebar(depth, title, page_id, sort_path), nested by depth."""
    order = pages.agg(F.sort_array(F.collect_list(F.struct("ord", "id", "title", "content", "parent_id"))).alias("p"))
    shown = F.transform(
        "p", lambda x: F.struct(
            x["id"].alias("id"), x["title"].alias("title"), x["content"].alias("content"), x["parent_id"].alias("parent_id"),
            x["ord"].alias("order")
        )
    )
    entries = sidebar.agg(F.sort_array(F.collect_list(F.struct("sort_path", "depth", "title", "page_id"))).alias("s"))

    def nest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["json"]:
                doc = json.loads(text)
                top: list[dict] = []
                open_: list[list[dict]] = [top]
                for depth, title, page_id in ((x["depth"], x["title"], x["page_id"]) for x in doc["sidebar"]):
                    del open_[depth + 1 :]
                    entry = {"title": title, "page_id": page_id}
                    open_[-1].append(entry)
                    open_.append(_Children(entry))
                out.append(json.dumps(doc | {"sidebar": top}, indent=2, ensure_ascii=False))
            yield pd.DataFrame({"json": out})

    flat = F.transform("s", lambda x: F.struct(x["depth"].alias("depth"), x["title"].alias("title"), x["page_id"].alias("page_id")))
    whole = F.to_json(F.struct(F.lit(project).alias("project_name"), shown.alias("pages"), flat.alias("sidebar")))
    return order.crossJoin(entries).select(whole.alias("json")).mapInPandas(nest, "json string")


class _Children:
    """The children of a sidebar entry, which has none until one is put in."""

    def __init__(self, entry: dict):
        self.entry = entry

    def append(self, child: dict) -> None:
        self.entry.setdefault("children", []).append(child)


def write_json(pages: DataFrame, path: str) -> None:
    """Rows of any table as JSON lines."""
    pages.select(F.to_json(F.struct(*pages.columns)).alias("value")).write.mode("overwrite").text(path)


def single_page(pages: DataFrame, title: str) -> DataFrame:
    """html: one row with every page of pages(id, title, content, ord), for a wiki that fits a browser."""
    body = F.concat(
        F.lit('<section id="'), escaped(F.col("id")), F.lit('"><h1>'), escaped(F.col("title")), F.lit("</h1>\n"),
        markdown_to_html(F.col("content")), F.lit("\n</section>")
    )
    link = F.concat(F.lit('<a href="#'), escaped(F.col("id")), F.lit('">'), escaped(F.col("title")), F.lit("</a>"))
    rows = pages.agg(F.sort_array(F.collect_list(F.struct("ord", "id", body.alias("body"), link.alias("link")))).alias("a"))
    part = lambda name: F.array_join(F.transform("a", lambda x: x[name]), "\n")
    head = escaped(F.lit(title))
    return rows.select(
        F.concat(
            F.lit('<!doctype html><html><head><meta charset="utf-8"><title>'), head, F.lit("</title></head><body><nav>"), part("link"),
            F.lit("</nav><main>"), part("body"), F.lit("</main></body></html>")
        ).alias("html")
    )


def read_metadata(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Tables of a wiki's metadata file: catalogs, items, relations."""
    return read_document(spark.createDataFrame([(read_text(folder, METADATA) or "{}",)], "json string"))
