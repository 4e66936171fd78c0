"""python -m scanlens.cli COMMAND: sample a source, load runs and dumps, refresh snapshots, write profiles."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .plans.sample import pull
from .plans.store import Store
from .service import Profiler
from .sources.pages import resolve_run_root
from .spec import MODALITIES


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="scanlens", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *options: tuple[str, dict]) -> None:
        one = commands.add_parser(name, help=text)
        one.add_argument("--modality", action="append", choices=list(MODALITIES), dest="modalities")
        for flag, more in options:
            one.add_argument(flag, **more)

    store = ("--store", {"required": True})
    command("pull-sample", "sample a paginated API", ("--base", {"required": True}), ("--data-root", {"required": True}), ("--pages", {"type": int}), ("--gigabytes", {"type": float}), ("--cap", {"type": int}))
    command("load-run", "load page files", store, ("--data-root", {}), ("--run-id", {}), ("--run-root", {}), ("--quarantine", {"action": "store_true"}))
    command("load-dump", "load dump files", store, ("--dump-root", {"required": True}), ("--quarantine", {"action": "store_true"}))
    command("refresh", "store the representatives anew", store)
    command("profile", "write profiles as JSON", store, ("--out", {"required": True}), ("--view", {"default": "raw", "choices": ["raw", "exact", "series"]}))
    return out


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("scanlens").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    match a.command:
        case "pull-sample":
            said = pull(spark, a.base, a.data_root, modalities=a.modalities, count=a.pages, gigabytes=a.gigabytes, cap=a.cap)
        case "load-run":
            root = resolve_run_root(spark, run_root=a.run_root, data_root=a.data_root, run_id=a.run_id)
            said = Store(spark, a.store).load_run(root, a.modalities, quarantine=a.quarantine).to_dict()
        case "load-dump":
            said = Store(spark, a.store).load_dump(a.dump_root, a.modalities, quarantine=a.quarantine).to_dict()
        case "refresh":
            Store(spark, a.store).refresh(a.modalities)
            said = {"refreshed": a.modalities or list(MODALITIES)}
        case "profile":
            said = {"written": str(Profiler(Store(spark, a.store)).write_profile(a.out, a.modalities, a.view))}
    print(json.dumps(said, indent=2))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
