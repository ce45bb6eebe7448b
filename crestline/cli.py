"""Commands: detect, cull, convert, classstat, classexport.

Exit codes: 1 usage, 2 load, 3 save (class commands: 3 metadata; 4 size mismatch or
save).
"""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from .functions.scales import parse_scales
from .operators import classes, entries
from .plans.detection import METRICS, detection
from .sources import files, ridg, tiff

log = logging.getLogger("crestline")


class Parser(argparse.ArgumentParser):
    def error(self, message: str):
        self.print_usage(sys.stderr)
        print(f"{self.prog}: {message}", file=sys.stderr)
        raise SystemExit(1)


class Failure(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def parser() -> Parser:
    top = Parser(prog="crestline")
    top.add_argument("-v", "--verbose", action="store_true")
    sub = top.add_subparsers(dest="command", required=True, parser_class=Parser)

    p = sub.add_parser("detect", help="find ridges in a float TIFF")
    mode = p.add_mutually_exclusive_group()
    for m in ("points", "segments", "lines"):
        mode.add_argument(f"-{m[0]}", f"--{m}", dest="mode", action="store_const", const=m)
    p.add_argument("-t", "--scale", action="append", default=[], metavar="T|START:STEP:END")
    p.add_argument("-m", "--metric", choices=METRICS, default="N")
    p.add_argument("-i", "--nan-value", type=float, default=0.0)
    p.add_argument("-j", "--partitions", type=int, help="shuffle partitions")
    for d in ("l", "lp", "lpp", "r"):
        p.add_argument(f"--dump-{d}", metavar="TIFF")
    p.add_argument("infile")
    p.add_argument("outfile", nargs="?")

    p = sub.add_parser("cull", help="drop weak entries")
    p.add_argument("-b", "--brightness", type=float)
    p.add_argument("-l", "--length", type=float)
    p.add_argument("-s", "--strength", type=float)
    p.add_argument("-i", "--invert", action="count", default=0)
    p.add_argument("infile")
    p.add_argument("outfile", nargs="?")

    p = sub.add_parser("convert", help="export entries")
    form = p.add_mutually_exclusive_group()
    for flag, name in (("-s", "svg"), ("-d", "pdf"), ("-c", "csv"), ("-p", "png"), ("-t", "tiff")):
        form.add_argument(flag, f"--{name}", dest="form", action="store_const", const=name)
    p.add_argument("--classes", action="store_true", help="colour SVG strokes by class")
    p.add_argument("infile")
    p.add_argument("outfile")

    p = sub.add_parser("classstat", help="class counts; later files against the first")
    p.add_argument("-s", "--summary", dest="dump", action="store_false", default=False)
    p.add_argument("-d", "--dump", dest="dump", action="store_true", default=False)
    p.add_argument("files", nargs="+")

    p = sub.add_parser("classexport", help="split entries by class")
    p.add_argument("infile")
    p.add_argument("out_a")
    p.add_argument("out_b")
    return top


def _load(spark: SparkSession, path: str):
    try:
        return files.load(spark, path)
    except Exception as e:
        raise Failure(2, f"cannot load {path}: {e}") from e


def _save(code: int, write, *args) -> None:
    try:
        write(*args)
    except Exception as e:
        raise Failure(code, f"cannot save: {e}") from e


def detect(spark: SparkSession, a) -> None:
    from .operators import blocks

    try:
        scales = [t for s in a.scale for t in parse_scales(s)] or [0.0]
    except ValueError as e:
        raise Failure(1, str(e)) from e
    if a.partitions is not None:
        if a.partitions < 1:
            raise Failure(1, "there must be a partition")
        spark.conf.set("spark.sql.shuffle.partitions", a.partitions)
    try:
        image_id, rows, cols = tiff.sizes(spark, a.infile).first()
        image = tiff.read(spark, a.infile)
        found = detection(image, scales, a.metric, a.nan_value)
    except Exception as e:
        raise Failure(2, f"cannot load {a.infile}: {e}") from e
    dumps = {"v": a.dump_l, "lp": a.dump_lp, "lpp": a.dump_lpp, "r": a.dump_r}
    if any(dumps.values()):
        t = min(scales)
        m = blocks.metrics_by_blocks(image, t, a.metric, a.nan_value)
        for column, path in dumps.items():
            if path:
                one = spark.createDataFrame([(files.located(path), image_id, rows, cols)], "file string, image_id string, rows int, cols int")
                _save(3, tiff.write, m, one, column)
    if a.outfile:
        _save(3, files.save, found.entries(a.mode or "segments"), a.outfile, ridg.image_size(rows, cols))
    else:
        log.info("%d edges", found.edges.count())


def cull(spark: SparkSession, a) -> None:
    data = _load(spark, a.infile)
    limits = (a.brightness, a.length, a.strength)
    kept = entries.cull(data.entries, *limits, invert=bool(a.invert % 2))
    n = entries.cull_counts(data.entries, *limits, invert=bool(a.invert % 2)).first()
    _save(3, files.save, kept, a.outfile or a.infile, data.metadata)
    print(f"Culled {n['culled']} of {n['total']}", file=sys.stderr)


def convert(spark: SparkSession, a) -> None:
    data = _load(spark, a.infile)
    if data.rows is None or data.cols is None:
        raise Failure(2, f"{a.infile} does not tell the image's size")
    _save(3, files.convert, data.entries, a.outfile, data.rows, data.cols, a.form, a.classes)


def classstat(spark: SparkSession, a) -> None:
    loaded = []
    for path in a.files:
        data = _load(spark, path).entries
        if data.filter("class is null").head(1):
            raise Failure(3, f"{path} has no classification")
        loaded.append(data.select("entry_id", "class", "likelihood"))
    first = loaded[0]
    if a.dump:
        likely = "likelihood" if first.filter("likelihood is not null").head(1) else None
        for r in classes.dump(first, "class", likely).toLocalIterator():
            print(r["line"])
        return
    s = classes.summary(first).first()
    print(f"A\t{s['a']}\t{s['a_percent'] or 0:.2f}%\nB\t{s['b']}\t{s['b_percent'] or 0:.2f}%\nN\t{s['n']}")
    for path, data in zip(a.files[1:], loaded[1:]):
        try:
            d = classes.difference(data, first).first()
        except Exception as e:
            raise Failure(4, f"{path} differs in size") from e
        print(f"{path}\nA->B\t{d['a_to_b']}\t{d['a_to_b_percent'] or 0:.2f}%\nB->A\t{d['b_to_a']}\t{d['b_to_a_percent'] or 0:.2f}%\nN\t{d['n']}")


def classexport(spark: SparkSession, a) -> None:
    loaded = _load(spark, a.infile)
    data = loaded.entries
    if data.filter("class is null").head(1):
        raise Failure(3, f"{a.infile} has no classification")
    for part, path in zip(classes.split(data), (a.out_a, a.out_b)):
        _save(4, files.save, part.drop("class", "likelihood"), path, ridg.image_size(loaded.rows, loaded.cols))


COMMANDS = {"detect": detect, "cull": cull, "convert": convert, "classstat": classstat, "classexport": classexport}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    logging.basicConfig(level=logging.INFO if a.verbose else logging.WARNING)
    spark = spark or SparkSession.builder.appName("crestline").getOrCreate()
    try:
        COMMANDS[a.command](spark, a)
    except Failure as e:
        print(f"crestline {a.command}: {e}", file=sys.stderr)
        return e.code
    return 0


if __name__ == "__main__":
    sys.exit(main())
