"""Command line: index, search, explore {tools, info, search, paths, text, chunks}."""

from __future__ import annotations

import argparse
import sys
import time
from dataclasses import asdict

from lodestrata import toon
from lodestrata.schema import SearchOptions

#: What ``explore tools`` shows: per tool its arguments and purpose.
USAGE = {
    "search": ("QUERY... [--top-k N] [--include-path LIKE] [--exclude-path LIKE] [--full]", "find passages by meaning; several queries share one ranking"),
    "text": ("TEXT [--path PATH] [--limit N]", "find lines that contain a string"),
    "paths": ("PATTERN [--limit N]", "find files by a part of their path"),
    "chunks": ("PATH [--start-line N --end-line M] [--full]", "show what a file defines, or some of its lines"),
    "info": ("", "count files, chunks and vectors"),
}
TOOLS = {
    "version": 2,
    "usage": [{"tool": name, "arguments": arguments, "purpose": purpose} for name, (arguments, purpose) in USAGE.items()],
    "options": "--db-path INDEX and --repo NAME for all but tools; --prose for text instead of tables",
}

#: Per kind of output the message for no rows, the title and the row layout (None: no title).
LAYOUTS = {
    "chunks": ("No chunks found.", None, "{path}:{start_line}-{end_line}{in_brackets}"),
    "outline": ("Nothing indexed for that path.", "{path}  ({n} entries)", "{span:<{width}}  {kind}  {name}"),
    "matches": ("No matches found.", None, "{path}:{mark}{line_number}: {text}"),
    "lines": ("No source lines found.", "{path}:{first}-{last}", "{line_number:>{width}}  {text}"),
    "results": ("No results found.  ({ms:.0f} ms)", "Found {n} result(s) in {ms:.0f} ms:\n", "{path}:{start_line}-{end_line}  {score:.3f}{tags}"),
    "paths": ("No paths found.", None, "{value}"),
}
_TEXTS = ("text", "snippet")


def _cells(row: object) -> dict:
    """Everything that a layout can show of a row."""
    if isinstance(row, str):
        return {"value": row}
    cells = asdict(row)
    kind, symbol = cells.get("chunk_kind"), cells.get("symbol")
    return cells | {
        "kind": kind or "chunk", "name": symbol or "-", "in_brackets": f"  [{kind}]" if kind else "", "tags": "".join(f"  {x}" for x in (kind, symbol) if x),
        "mark": "" if cells.get("exact_line", True) else "~", "span": f"{cells.get('start_line')}-{cells.get('end_line')}",
    }


def prose(layout: str, rows: list, full: bool = False, **about) -> str:
    """Rows in their layout; with ``full`` each with its text, indented, below it."""
    nothing, title, line = LAYOUTS[layout]
    cells = [_cells(r) for r in rows]
    about |= {"n": len(rows)}
    if not rows:
        return nothing.format(**about)
    if "line_number" in cells[0]:
        about |= {"first": cells[0]["line_number"], "last": cells[-1]["line_number"], "width": len(str(cells[-1]["line_number"]))}
    elif "span" in cells[0]:
        about["width"] = max(len(c["span"]) for c in cells)
    out = [title.format(**about)] if title else []
    for c in cells:
        out.append(line.format(**(about | c)))
        if full:
            body = next(c[x] for x in _TEXTS if x in c)
            out += [*("    " + x for x in body.splitlines()), ""]
    return "\n".join(out)


def table(rows: list, *without: str) -> list[dict]:
    """Rows as compact tables show them: scores to three digits, no columns of ``without``."""
    return [{k: round(v, 3) if k == "score" else v for k, v in asdict(r).items() if k not in without} for r in rows]


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lodestrata")
    commands = parser.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index")
    index.add_argument("repo_path")
    index.add_argument("--watch", action="store_true")
    index.add_argument("--full", action="store_true")
    search = commands.add_parser("search")
    search.add_argument("query")
    search.add_argument("--top-k", "--top_k", type=int, default=10)
    explore = commands.add_parser("explore").add_subparsers(dest="tool", required=True)
    tools = explore.add_parser("tools")
    info = explore.add_parser("info")
    meaning = explore.add_parser("search")
    meaning.add_argument("queries", nargs="+")
    meaning.add_argument("--top-k", "--top_k", type=int, default=10)
    meaning.add_argument("--include-path", "--include_path", action="append", default=[])
    meaning.add_argument("--exclude-path", "--exclude_path", action="append", default=[])
    paths = explore.add_parser("paths")
    paths.add_argument("pattern")
    paths.add_argument("--limit", type=int, default=50)
    text = explore.add_parser("text")
    text.add_argument("text")
    text.add_argument("--path")
    text.add_argument("--limit", type=int, default=20)
    chunks = explore.add_parser("chunks")
    chunks.add_argument("path")
    chunks.add_argument("--start-line", "--start_line", type=int)
    chunks.add_argument("--end-line", "--end_line", type=int)
    for p in (meaning, chunks):
        p.add_argument("--full", action="store_true")
    for p in (tools, info, meaning, paths, text, chunks):
        p.add_argument("--prose", action="store_true")
        p.add_argument("--toon", "--json-output", "--json_output", action="store_true", help="accepted, without effect")
    for p in (index, search, info, meaning, paths, text, chunks):
        p.add_argument("--repo", help="name of the repository; default: the folder's name, or all of the index")
        p.add_argument("--db-path", "--db_path", default="lodestrata-index")
    return parser


def run(args: argparse.Namespace, spark, embedder=None) -> str:
    """The output of a command."""
    from lodestrata.embed import make_embedder
    from lodestrata.plans.indexer import build_index
    from lodestrata.plans.reader import SourceReader

    if args.command == "index":
        report = build_index(spark, args.repo_path, args.db_path, embedder, repo=args.repo, full=args.full, on_file=lambda p, c: print(f"{c:<9} {p}") if c != "unchanged" else None)
        if args.watch:
            from lodestrata.streaming.watch import watch

            watch(spark, args.repo_path, args.db_path, embedder, on_change=print, repo=args.repo).awaitTermination()
        return f"added {report.added}, changed {report.changed}, unchanged {report.unchanged}, deleted {report.deleted}"
    if args.command == "explore" and args.tool == "tools":
        return "\n".join(f"{name} {arguments}: {purpose}" for name, (arguments, purpose) in USAGE.items()) if args.prose else toon.dumps(TOOLS)
    began = time.time()
    with SourceReader(spark, args.db_path, args.repo) as reader:
        def shown(layout: str, rows: list, value: dict, full: bool = False, **about) -> str:
            return prose(layout, rows, full, ms=(time.time() - began) * 1000, **about) if getattr(args, "prose", True) else toon.dumps(value)

        if args.command == "search":
            return shown("results", reader.search(args.query, args.top_k, embedder=embedder or make_embedder()), {}, full=True)
        if args.tool == "info":
            found = asdict(reader.index_info())
            return " ".join(f"{k}={v}" for k, v in found.items()) if args.prose else toon.dumps(found)
        if args.tool == "search":
            options = SearchOptions(args.top_k, tuple(args.include_path), tuple(args.exclude_path))
            found = reader.semantic_search(args.queries, embedder=embedder or make_embedder(), options=options)
            return shown("results", found, {"results": table(found, *([] if args.full else ["snippet"]))}, full=args.full)
        if args.tool == "paths":
            found = reader.find_paths(args.pattern, limit=args.limit)
            return shown("paths", found, {"paths": found})
        if args.tool == "text":
            found = reader.find_text_lines(args.text, path=args.path, limit=args.limit)
            return shown("matches", found, {"matches": table(found)})
        if args.start_line is not None or args.end_line is not None:  # a range wins over --full
            found = reader.get_source_lines(args.path, start_line=args.start_line or 1, end_line=args.end_line or 2**31 - 1)
            return prose("lines", found, path=args.path)
        if args.full:
            found = reader.get_chunks(args.path)
            return shown("chunks", found, {"chunks": table(found)}, full=True)
        found = reader.get_outline(args.path)
        return shown("outline", found, {"path": args.path, "outline": table(found)}, path=args.path)


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("lodestrata").getOrCreate()
    try:
        print(run(args, spark))
    except (ValueError, RuntimeError, FileNotFoundError) as error:
        print(f"Error: {error}", file=sys.stderr)
        return 1
    return 0
