"""Command line: text -> model -> statistics -> generated text.

    python -m gramlake -c corpus.txt -b 5 --stats --generate 200 -p "The " -o out.txt
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gramlake.functions.language import Language
from gramlake.operators.service import Model
from gramlake.sources import readers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gramlake", description=__doc__.split("\n")[0])
    p.add_argument("-c", "--corpus", help="text file(s); each file is one text")
    p.add_argument("-l", "--language", help="JSON map of pieces to tokens; the corpus must be valid in it")
    p.add_argument("-m", "--model", help="folder of a model: read if there is no corpus, else written")
    p.add_argument("-b", "--block-size", type=int, default=5)
    p.add_argument("-v", "--split", type=float, help="share of each text, from its front, to parse; the rest is scored")
    p.add_argument("-g", "--generate", type=int, default=0, help="characters to generate")
    p.add_argument("-p", "--prompt", default="\n")
    p.add_argument("-o", "--output", default="-", help="file for generated text")
    p.add_argument("-s", "--stats", action="store_true", help="prefixes, patterns and their shares")
    p.add_argument("--memory", action="store_true", help="estimated size of the model")
    p.add_argument("-q", "--quiet", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("gramlake").getOrCreate()
    began = time.time()
    say = lambda *x: args.quiet or print(f"[{time.time() - began:8.3f}s]", *x, file=sys.stderr)
    held_out = None
    if args.corpus:
        docs = readers.whole_texts(spark, args.corpus)
        if args.language:
            language = Language.from_json_file(spark, args.language)
            if bad := docs.where(~language.is_valid(F.col("text"))).select("path").take(1):
                raise SystemExit(f"{bad[0][0]} is not valid in the language")
        if args.split is not None:
            cut = F.floor(F.length("text") * args.split).cast("int")
            held_out = docs.select("path", F.expr("substring(text, greatest(floor(length(text) * %r) - %d, 0) + 1)" % (args.split, args.block_size + 1)).alias("text"))
            docs = docs.withColumn("text", F.left("text", cut))
        model = Model.parse_all(docs, args.block_size, dense=False).densify()
        if args.model:
            model.save(args.model)
    elif args.model:
        model = Model.load(spark, args.model, args.block_size)
    else:
        raise SystemExit("give a corpus or a model")
    model.cache()
    if args.stats:
        sizes = model.sizes()
        events = sizes["occurrences"] or 1
        say(f"{sizes['prefixes']} prefixes ({100 * sizes['prefixes'] / events:.1f}%), {sizes['patterns']} patterns ({100 * sizes['patterns'] / events:.1f}%), {sizes['patterns'] / max(1, sizes['prefixes']):.1f} successors each")
    if args.memory:
        say(f"about {model.memory()} bytes")
    if held_out is not None:
        for row in model.perplexity(held_out, ("path",)).collect():
            say(f"{row['path']}: perplexity {row['perplexity']:.4f}")
    if args.generate:
        (text,) = model.generate(args.prompt, args.generate)
        if args.output == "-":
            print(text)
        else:
            with open(args.output, "w", encoding="utf-8") as f:
                f.write(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
