"""Command line: ``python -m trainprep (--pretraining | --instruct | --dpo |
--completion-choice | --blank-choice) --sources sources.json --out PATH
[--mix-file mix.json]``.

``sources.json`` names the inputs: ``{source_id: {config_name: {"format": "parquet",
"path": "...", "kind": "text|turns|messages|pairs", "options": {...}}}}``. Without
``--mix-file`` every configured source gets an equal weight and seed 42.

The choice stages write one JSON-lines folder per source below ``--out`` and leave one
that exists untouched. A completion source has ``ctx``, ``endings`` and ``label``, a blank
source ``sentence``, ``option1``, ``option2`` and ``answer``; both may have ``item_id``
(otherwise a hash of the row names the item).
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from trainprep.operators import normalize as nz
from trainprep.plans.prepare import prepare_choice, prepare_instruct, prepare_preference, prepare_pretraining
from trainprep.sources.io import Source, SourceRegistry

ADAPTERS = {
    "text": None,
    "turns": nz.adapt_messages,
    "messages": lambda df: nz.adapt_message_list(df, "messages"),
    "pairs": None,
}


def build_registry(cfg: dict) -> SourceRegistry:
    reg = SourceRegistry()
    for source_id, names in cfg.items():
        for name, c in names.items():
            kind = c.get("kind", "text")
            reg.register(source_id, name, Source(c.get("format", "parquet"), c["path"], c.get("options", {}),
                                                 ADAPTERS[kind], kind=kind))
    return reg


def default_mix(cfg: dict, shard_size: int | None) -> dict:
    entries = [(s, n) for s, names in cfg.items() for n in names]
    spec = {"seed": 42, "datasets": {}}
    for s, n in entries:
        spec["datasets"].setdefault(s, {})[n] = {"weight": 1.0 / len(entries), "transforms": {}}
    if shard_size:
        spec["shard_size"] = shard_size
    return spec


def main(argv=None):
    p = argparse.ArgumentParser(prog="trainprep")
    stage = p.add_mutually_exclusive_group(required=True)
    stage.add_argument("--pretraining", action="store_true")
    stage.add_argument("--instruct", action="store_true")
    stage.add_argument("--dpo", action="store_true")
    stage.add_argument("--completion-choice", action="store_true")
    stage.add_argument("--blank-choice", action="store_true")
    p.add_argument("--sources", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--mix-file")
    p.add_argument("--tokenizer", default="bytes")
    p.add_argument("--shard-size", type=int, default=100_000_000)
    p.add_argument("--size", type=int, help="items taken of each choice source")
    p.add_argument("--strict", action="store_true", help="a source shorter than its limit is an error")
    p.add_argument("--resume", action="store_true", help="continue stored pretraining shards")
    a = p.parse_args(argv)
    with open(a.sources) as fh:
        cfg = json.load(fh)
    if a.mix_file:
        with open(a.mix_file) as fh:
            spec = json.load(fh)
    else:
        spec = default_mix(cfg, a.shard_size if a.pretraining else None)
    spark = SparkSession.builder.appName("trainprep").getOrCreate()
    reg = build_registry(cfg)
    if a.completion_choice or a.blank_choice:
        kind = "completion" if a.completion_choice else "blank"
        summary = prepare_choice(spark, reg, a.out, kind, a.tokenizer, a.size, a.strict)
    elif a.pretraining:
        summary = prepare_pretraining(spark, spec, reg, a.out, a.tokenizer, resume=a.resume)
    elif a.instruct:
        summary = prepare_instruct(spark, spec, reg, a.out, a.tokenizer, strict=a.strict)
    else:
        summary = prepare_preference(spark, spec, reg, a.out, a.tokenizer, strict=a.strict)
    summary.orderBy(*summary.columns[:2]).show(50, truncate=False)


if __name__ == "__main__":
    main()
