"""Programs: `python -m velograph run|verify CONFIG.yaml STORE.yaml` and `python -m velograph timing [FOLDER]`.

STORE.yaml has `folder`, where tables are written, that all executors reach; and may have `seed`, of the shifts of
in-situ iterations, `tolerance`, over which a check fails, and `spark`, settings of a session made here. With
spark-submit, Spark's own settings count. Exit code 1: wrong arguments or settings, a file that isn't there, a check that
fails.
"""

from __future__ import annotations

import logging
import sys

from pyspark.sql import SparkSession

from velograph import config
from velograph.plans import simulate
from velograph.sources import files, generate

USAGE = "usage: velograph run CONFIG.yaml STORE.yaml | verify CONFIG.yaml STORE.yaml | timing [FOLDER]"


def session(settings: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName("velograph")
    for k, v in (settings or {}).items():
        builder = builder.config(k, str(v))
    return builder.getOrCreate()


def _folder(store: dict) -> str:
    if not store.get("folder"):
        raise SystemExit("Error: STORE.yaml has no folder")
    return str(store["folder"])


def run(args: list[str]) -> int:
    setting, store = config.parse_args(args, USAGE)
    spark, top = session(store.get("spark")), _folder(store)
    simulate.simulate(spark, setting, generate.random_shifts(spark, setting.n_iterations, int(store.get("seed", 0))), top)
    return 0


def verify(args: list[str]) -> int:
    setting, store = config.parse_args(args, USAGE)
    spark, top = session(store.get("spark")), _folder(store)
    if not files.exists(spark, f"{top}/{files.DISTRIBUTION}"):
        raise SystemExit(f"Error: {top}/{files.DISTRIBUTION} not found")
    found = simulate.verify_run(spark, setting, top).first()
    print(f"Max Abs Error: {found.max_abs_error}, Max Rel Error: {found.max_rel_error}, NaN: {found.n_nan}")
    return int("tolerance" in store and (found.n_nan > 0 or not found.max_abs_error <= float(store["tolerance"])))


def timing(args: list[str]) -> int:
    print(files.read_timing(session(), args[0] if args else "."))
    return 0


def main(args: list[str]) -> int:
    chosen = {"run": run, "verify": verify, "timing": timing}.get(args[0]) if args else None
    if chosen is None:
        print(USAGE, file=sys.stderr)
        return 1
    logging.basicConfig(level=logging.WARNING, format="%(message)s", stream=sys.stdout)
    logging.getLogger("velograph").setLevel(logging.INFO)
    return chosen(args[1:])


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
