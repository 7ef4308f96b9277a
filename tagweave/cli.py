"""Command line for the file-to-file jobs.

  python -m tagweave.cli evaluate DATA_DIR OUT_DIR [--run NAME] [--model MOD:FACTORY]
                                  [--num-samples N] [--max-tokens 300] [--embedder MOD:FACTORY]
  python -m tagweave.cli curate GENERATION_PATH OUT_DIR [--judge MOD:FACTORY] [--min-freq 2]
                                [--min-gap 2.0] [--min-privacy 7.0] [--format dpo_weighted]
  python -m tagweave.cli report RESULTS_DIR OUT_DIR
  python -m tagweave.cli filter GENERATION_PATH OUT_DIR [--min-freq 2] [--positions 0,1,2,3]
  python -m tagweave.cli export ANNOTATED_PATH OUT_PATH [--format dpo]

A model / judge / embedder is named as ``module:function`` returning the
callable (built once per partition on the executors). Without one, the
built-in stand-ins are used (word-count tagger, rule judge, no embedder).
Summary tables are printed as JSON lines.
"""

from __future__ import annotations

import argparse
import importlib
import json

from tagweave.session import build_session


def _load(spec: str | None):
    if not spec:
        return None
    mod, _, name = spec.partition(":")
    return getattr(importlib.import_module(mod), name)


def _print(df, limit: int = 1000) -> None:
    """Print the first ``limit`` rows of a summary, and say so if there are more."""
    rows = df.limit(limit + 1).toJSON().collect()
    for row in rows[:limit]:
        print(row)
    if len(rows) > limit:
        print(json.dumps({"more_rows": f"only the first {limit} are printed; all are in the output folder"}))


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="tagweave")
    ap.add_argument("--checkpoint-dir", help="folder shared by driver and executors (spark.checkpoint.dir)")
    sub = ap.add_subparsers(dest="cmd", required=True)
    ev = sub.add_parser("evaluate")
    ev.add_argument("data_dir")
    ev.add_argument("output_dir")
    ev.add_argument("--run", default="model")
    ev.add_argument("--model")
    ev.add_argument("--embedder")
    ev.add_argument("--num-samples", type=int)
    ev.add_argument("--max-tokens", type=int, default=300)
    ev.add_argument("--batch-size", type=int, default=8)
    ev.add_argument("--max-in-flight", type=int, default=1)
    ev.add_argument("--vector-cache", help="folder that keeps the embedder's vectors over runs")
    cu = sub.add_parser("curate")
    cu.add_argument("generation_path")
    cu.add_argument("output_dir")
    cu.add_argument("--judge")
    cu.add_argument("--min-freq", type=int, default=2)
    cu.add_argument("--min-gap", type=float, default=2.0)
    cu.add_argument("--min-privacy", type=float, default=7.0)
    cu.add_argument("--format", default="dpo_weighted")
    cu.add_argument("--max-in-flight", type=int, default=1)
    rp = sub.add_parser("report")
    rp.add_argument("results_dir")
    rp.add_argument("output_dir")
    fi = sub.add_parser("filter")
    fi.add_argument("generation_path")
    fi.add_argument("output_dir")
    fi.add_argument("--min-freq", type=int, default=2)
    fi.add_argument("--positions", default="0,1,2,3")
    ge = sub.add_parser("generate")
    ge.add_argument("input_path")
    ge.add_argument("output_dir")
    ge.add_argument("--model", required=True)
    ge.add_argument("--model-name", default="model")
    ge.add_argument("--temperatures", default="0.5,0.9")
    ge.add_argument("--start", type=int, default=0)
    ge.add_argument("--end", type=int)
    ge.add_argument("--limit", type=int)
    ge.add_argument("--batch-size", type=int, default=8)
    ge.add_argument("--max-in-flight", type=int, default=1)
    sf = sub.add_parser("sft")
    sf.add_argument("input_path")
    sf.add_argument("output_dir")
    sf.add_argument("--before", required=True)
    sf.add_argument("--after", required=True)
    sf.add_argument("--run", default="sft")
    sf.add_argument("--eval-fraction", type=float, default=0.2)
    sf.add_argument("--batch-size", type=int, default=8)
    ex = sub.add_parser("export")
    ex.add_argument("annotated_path")
    ex.add_argument("output_path")
    ex.add_argument("--format", default="dpo")
    args = ap.parse_args(argv)

    from tagweave.operators import modelcall
    from tagweave.plans import jobs

    spark = build_session(extra={"spark.checkpoint.dir": args.checkpoint_dir} if args.checkpoint_dir else None)
    if args.cmd == "evaluate":
        model = _load(args.model) or (lambda: modelcall.word_count_tagger)
        emb_factory = _load(args.embedder)
        embed = (lambda t: modelcall.embed_tags(t, emb_factory)) if emb_factory else None
        out = jobs.evaluate_files(spark, args.data_dir, args.output_dir, model, args.run, embed,
                                  args.num_samples, args.max_tokens, args.batch_size, max_in_flight=args.max_in_flight,
                                  vector_cache=args.vector_cache, encoder=args.embedder or "encoder")
        _print(out["overall"])
        _print(out["metrics"])
    elif args.cmd == "curate":
        out = jobs.curate_preferences(spark, args.generation_path, args.output_dir, _load(args.judge),
                                      args.min_freq, args.min_gap, args.min_privacy, args.format,
                                      max_in_flight=args.max_in_flight)
        _print(out["filter_stats"])
        _print(out["outcomes"])
        print(json.dumps({"exported": out["export"].count()}))
    elif args.cmd == "report":
        out = jobs.report_results(spark, args.results_dir, args.output_dir)
        _print(out["quality"])
        _print(out["compare"])
    elif args.cmd == "filter":
        positions = [int(p) for p in args.positions.split(",") if p.strip()]
        out = jobs.filter_generation(spark, args.generation_path, args.output_dir, args.min_freq, positions)
        _print(out["stats"])
    elif args.cmd == "generate":
        temperatures = tuple(float(t) for t in args.temperatures.split(",") if t.strip())
        out = jobs.generate_records(spark, args.input_path, args.output_dir, _load(args.model), args.model_name, temperatures, args.start,
                                    args.end, args.limit, args.batch_size, max_in_flight=args.max_in_flight)
        print(json.dumps({"records": out.count()}))
    elif args.cmd == "sft":
        _print(jobs.sft_run(spark, args.input_path, args.output_dir, _load(args.before), _load(args.after), args.run,
                            args.eval_fraction, args.batch_size))
    else:
        out = jobs.export_annotated(spark, args.annotated_path, args.output_path, args.format)
        print(json.dumps({"exported": out.count()}))


if __name__ == "__main__":
    main()
