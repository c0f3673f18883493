"""``python -m passagemill ingest|query|eval``"""

from __future__ import annotations

import argparse
import json
import sys

from pyarrow.fs import FileType
from pyspark.sql import functions as F

from passagemill import api
from passagemill.operators.packaging import format_hit
from passagemill.schemas import IngestError, QueryError
from passagemill.session import local_session
from passagemill.sources.files import golden_rows
from passagemill.sources.folder import opened


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="passagemill")
    commands = parser.add_subparsers(dest="command", required=True)
    command = commands.add_parser("ingest", help="index a file or a folder")
    command.add_argument("path")
    command.add_argument("--index", required=True)
    command.add_argument("--keep-going", action="store_true", help="report refused files instead of stopping")
    command = commands.add_parser("query", help="search an index")
    command.add_argument("text")
    command.add_argument("--index", required=True)
    command.add_argument("--doc")
    command.add_argument("--mode", help="default: the mode that the last eval chose, else cascade")
    command = commands.add_parser("eval", help="score a golden set of JSON lines")
    command.add_argument("--index", required=True)
    command.add_argument("--golden", required=True)
    command.add_argument("--report", help="JSON file for the scores; default: in the index, where query finds its mode")
    command.add_argument("--answers", help="JSON lines of q and answer: written texts to look for the expected spans in")
    command.add_argument("--timed", action="store_true", help="measure the latency of each query")
    return parser


def _report_path(index_dir: str) -> str:
    return f"{index_dir.rstrip('/')}/report.json"


def live_mode(index_dir: str) -> str:
    """The mode chosen by the report kept in the index; without one, the cascade."""
    fs, path = opened(_report_path(index_dir))
    if fs.get_file_info(path).type == FileType.NotFound:
        return "cascade"
    with fs.open_input_stream(path) as handle:
        return json.loads(handle.read())["live_mode"]


def _query(spark, args) -> str:
    if not args.text.strip():
        raise QueryError("empty query")
    index = api.open_index(spark, args.index)
    if not index.exists:
        return "no hits"
    answer = api.ask(index, args.text, args.doc, args.mode or live_mode(args.index))
    reason = answer.status.collect()[0].reason
    if reason:
        return reason
    lines = answer.hits.orderBy("rank").select(format_hit().alias("line")).collect()
    return "\n\n".join(r.line for r in lines) or "no hits"


def _evaluate(spark, args) -> str:
    index = api.open_index(spark, args.index)
    golden = golden_rows(spark, args.golden)
    corpus = index.corpus()
    timings = api.time_modes(corpus, golden) if args.timed else None
    scores, tau, answers = api.evaluate(corpus, golden, timings=timings, save_tau=index.set_tau)
    span = (None, 0)
    if args.answers:
        written = spark.read.schema("q string, answer string").json(args.answers)
        span = api.span_score(golden, scores, answers, written)
    result = api.report(scores, tau, span)
    fs, path = opened(args.report or _report_path(args.index))
    with fs.open_output_stream(path) as handle:
        handle.write(json.dumps(result, indent=2).encode())
    # Fixed value: the format of a line of scores.
    lines = [
        f"{s['mode']:10} {s['kind']:10} recall@5={s['recall']:.2f} mrr={s['mrr']:.2f} "
        f"abstain={s['abstain']:.2f} p50={s['p50']:.0f}ms n={s['n']}"
        for s in result["scores"]
    ]
    lines.append("tau unset" if tau is None else f"tau={tau:.4f}")
    if span[0] is not None:
        lines.append(f"span={span[0]:.2f} n={span[1]}")
    return "\n".join([*lines, f"live={result['live_mode']}"])


def main(argv: list[str] | None = None, spark=None) -> int:
    args = _parser().parse_args(argv)
    try:
        if args.command == "query" and not args.text.strip():
            raise QueryError("empty query")
        spark = spark or local_session(app="passagemill-cli")
        if args.command == "ingest":
            report = api.ingest(spark, args.path, args.index, fail_fast=not args.keep_going)
            line = F.concat_ws("  ", "status", "doc_id", F.col("chunks").cast("string"), "reason")
            for row in report.select(line.alias("line")).toLocalIterator():
                print(row.line)
        else:
            print(_query(spark, args) if args.command == "query" else _evaluate(spark, args))
    except (IngestError, QueryError) as error:
        print(error, file=sys.stderr)
        return 1
    return 0
