"""Jobs from the command line: ``python -m folioscope.jobs recognise|translate|upload|chunks|ask|run-all ...``.

Tables are snapshots in folders.  Models come from a provider by name; the offline ones need no network.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ids
from .operators import answer, chunking, structure, sync
from .operators import translation as T
from .plans import prompts
from .plans import providers as P
from .plans.session import session, written
from .sources import pages as S
from .sources import snapshots as N

CHUNKS = "guid string, owner string, parent string, ord int, source_key string, language string, page_number int, text string, page_digest string, embedding array<double>"
LOT = 200  # pages that a recognition job commits at once


def stored(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The current snapshot, or an empty table before the first."""
    try:
        return N.current(spark, folder)
    except LookupError:
        return spark.createDataFrame([], schema)


def build_chunks(spark: SparkSession, pages: str, chunks: str, provider: str = "offline", budget: int = chunking.BUDGET, tokenizer: str | None = None) -> dict[str, int]:
    """Chunks and embeddings of the stored pages that have none or have changed; chunks of pages that went go.

    ``tokenizer``: the file of a public tokenizer, to count tokens with; None: words.  A second run embeds nothing.
    """
    old, now = stored(spark, chunks, CHUNKS), N.current(spark, pages)
    own = now.select(F.col("guid").alias("parent"), F.col("digest").alias("page_digest"))
    todo = now.join(old.select(F.col("parent").alias("guid"), F.col("page_digest").alias("digest")).distinct(), ["guid", "digest"], "left_anti")
    rows = chunking.chunk_rows(todo, budget, count=chunking.bpe_tokens(tokenizer) if tokenizer else None).join(own, "parent")
    new = written(P.embed_column(rows, P.providers(provider).embedder).select(*old.columns), "chunks")
    gone = written(old.join(own, ["parent", "page_digest"], "left_anti").select("guid", "parent"), "gone")
    N.merge(spark, chunks, new, gone)
    return {"chunks": new.count(), "removed": gone.join(new, "guid", "left_anti").count()}


def upload(spark: SparkSession, folder: str, pages: str, sources: str, chunks: str | None = None) -> dict[str, int]:
    """Stored pages and sources made equal to the page documents on disk, and ``chunks`` rid of those of pages that went; gives the number of rows by action.

    Digests stand on three levels.  A source whose files have the sizes and times they had isn't read; a page whose texts are
    the same isn't written; ``blocks`` counts the blocks of updated pages that differ.
    """
    found = written(S.source_stamps(S.page_files(spark, folder)), "sources")
    known = stored(spark, sources, "guid string, owner string, source_key string, language string, title string, recognised_pages long, first_page int, files long, stamp long")
    key = ["source_key", "language"]
    changed = found.join(known.select(*key, "files", "stamp"), [*key, "files", "stamp"], "left_anti")
    lost = written(known.join(found, key, "left_anti").select("guid"), "lost")
    # the names of sources that have changed go to the driver: their folders are what is read
    docs = S.read_page_json(spark, folder, [(r["language"], r["source_key"]) for r in changed.select(*key).collect()])
    new = written(S.page_rows(docs), "pages")
    old = stored(spark, pages, _ddl(new))
    touched = old.join(new.select("owner").unionByName(lost.select(F.col("guid").alias("owner"))).distinct(), "owner", "left_semi")
    todo = written(sync.actions(touched, new, "guid", "digest"), "actions")
    gone = todo.filter("action = 'delete'").select("guid")
    done = {r["action"]: r["count"] for r in todo.groupBy("action").count().collect()}
    both = new.select("guid", "block_digests").join(old.select("guid", F.col("block_digests").alias("was")), "guid").join(todo.filter("action = 'update'"), "guid")
    if blocks := both.agg(F.sum(F.size(F.array_except("block_digests", F.coalesce("was", F.array().cast("array<string>")))))).first()[0]:
        done["blocks"] = blocks
    if chunks is not None:
        stale = written(stored(spark, chunks, CHUNKS).join(gone.select(F.col("guid").alias("parent")), "parent").select("guid"), "stale")
        N.merge(spark, chunks, gone=stale)
        if n := stale.count():
            done["chunks"] = n
    N.merge(spark, pages, new.join(todo.filter("action <> 'delete'").select("guid"), "guid", "left_semi"), gone)
    # sources come last: a job that failed before finds the same sources to do
    N.merge(spark, sources, S.source_rows(docs).join(found, key), lost)
    return done


def _ddl(df: DataFrame) -> str:
    return df.schema.simpleString().removeprefix("struct<").removesuffix(">")


def recognise(spark: SparkSession, images: DataFrame, recogniser: P.Recogniser, folder: str, start: int = 1, end: int | None = None, force: bool = False, attempts: int = 4) -> dict[str, int]:
    """Pages of a window that have no document yet are recognised, built and written as page documents. ``images``: ``source_key, language, page, content``.

    Pages are committed in lots of about LOT: each page has a folder of its own, which a page that is done again replaces, and
    then a row of the manifest.  A run that is repeated asks for what is missing alone.  A page that fails is written nowhere and
    counted; the others stay.
    """
    key = ["source_key", "language", "page"]
    wanted = images.select(*key[:2], F.col("page").cast("int").alias("page"), "content")
    wanted = wanted.filter(F.col("page") >= start) if end is None else wanted.filter(F.col("page").between(start, end))
    manifest = f"{folder}/manifest"
    if not force and S.there(spark, manifest):
        wanted = wanted.join(spark.read.schema(MANIFEST).parquet(manifest).select(*key).distinct(), key, "left_anti")
    lots = -(-wanted.count() // LOT)
    done = {"recognised": 0, "failed": 0}
    for lot in range(lots):
        part = wanted.filter(F.pmod(F.xxhash64(*key), F.lit(lots)) == lot)
        got = written(P.recognise_pages(part, recogniser, attempts=attempts, keep_errors=True), "recognised")  # models are asked once
        good = structure.build_blocks(got.filter("error IS NULL").drop("error"))
        S.write_page_json(good, folder)
        rows = got.filter("error IS NULL").select(*key, F.current_timestamp().alias("at"))
        rows.write.mode("append").parquet(manifest)
        n, failed = got.agg(F.count_if(F.col("error").isNull()), F.count("error")).first()
        done = {"recognised": done["recognised"] + n, "failed": done["failed"] + failed}
    return done


MANIFEST = "source_key string, language string, page int, at timestamp"


def translate(spark: SparkSession, units: DataFrame, cache: str, call: Callable) -> DataFrame:
    """Units (``id, text``) with translations, from the cache where it has them; the cache then has all."""
    known = stored(spark, cache, "id string, translated string")
    out = written(P.translate_missing(units, known, call).filter("translated IS NOT NULL").select("id", "translated"), "translated")
    N.merge(spark, cache, out.join(known, ["id", "translated"], "left_anti"), key="id")
    return units.join(stored(spark, cache, "id string, translated string"), "id", "left")


def translate_source(spark: SparkSession, folder: str, source_language: str, languages: list[str], call: Callable[[dict], dict], terms: str = "", start: int = 1, end: int | None = None, force: bool = False, attempts: int = 4) -> dict[str, dict[str, int]]:
    """Page documents of a window in other languages, beside the source's; gives translated and failed pages by language.

    Pages that a language has already stay and aren't asked for, unless ``force``.  A page goes to the model with the end of the
    page before it.  Each language is committed by itself, pages before the manifest; ``index`` has a row for each page, with
    blocks, words, the least scale of its type, blocks that lost marks, and blocks without a translation.
    """
    if bad := [x for x in languages if x == source_language]:
        raise ValueError(f"a book isn't translated into its own language: {bad}")
    key = ["source_key", "page"]
    everything = S.read_page_json(spark, folder).filter(F.col("language") == source_language)
    window = (F.col("page") >= start) if end is None else F.col("page").between(start, end)
    asked = T.requests(everything).filter(window)
    out = {}
    for language in languages:
        manifest = f"{folder}/translated-manifest/{language}"
        todo, pages = asked, everything.filter(window)
        if not force and S.there(spark, manifest):
            done = spark.read.schema("source_key string, page int, at timestamp").parquet(manifest).select(*key).distinct()
            todo, pages = todo.join(done, key, "left_anti"), pages.join(done, key, "left_anti")
        prompt = prompts.TRANSLATE.format(source=answer.language_name(source_language), target=answer.language_name(language), terms=terms)
        texts = written(P.translate_units(todo, call, prompt, attempts), "texts")  # models are asked once
        failed = texts.filter("error IS NOT NULL").select(*key).distinct()
        made = written(T.translated_pages(pages.join(failed, key, "left_anti"), texts.filter("error IS NULL"), language), "translated")
        S.write_page_json(made, folder)
        index = sync.translated_index(made).join(made.select("source_key", "language", "page", "printed_page_number", "marks_lost", F.size("missing").alias("missing")), ["source_key", "language", "page"])
        N.merge(spark, f"{folder}/translated-index", index.withColumn("guid", ids.page_id(F.col("source_key"), F.col("language"), F.col("page"))))
        made.select(*key, F.current_timestamp().alias("at")).write.mode("append").parquet(manifest)
        out[language] = {"translated": made.count(), "failed": failed.count()}
    return out


def ask(spark: SparkSession, pages: str, chunks: str, question: str, provider: str = "offline", **flags) -> dict:
    """One question's reply."""
    p = N.current(spark, pages)
    corpus = answer.Corpus(N.current(spark, chunks).withColumn("page", F.col("page_number")), p.select("guid", "text"))
    return answer.ask(spark, corpus, question, P.providers(provider), answer.Flags(**flags)).reply()


def run_all(spark: SparkSession, images: str, folder: str, pages: str, sources: str, chunks: str, source_language: str, languages: list[str], recogniser: str = "offline", translator: str = "offline", provider: str = "offline", tokenizer: str | None = None) -> dict[str, dict]:
    """Recognition, translation, upload and chunks, one after the other; each does what is missing alone."""
    return {
        "recognise": recognise(spark, S.page_images(spark, images), P.by_name(P.RECOGNISERS, recogniser)(), folder),
        "translate": translate_source(spark, folder, source_language, languages, P.by_name(P.TRANSLATORS, translator)),
        "upload": upload(spark, folder, pages, sources, chunks),
        "chunks": build_chunks(spark, pages, chunks, provider, tokenizer=tokenizer),
    }


def _recognise(spark: SparkSession, images: str, recogniser: str, **options) -> dict[str, int]:
    return recognise(spark, S.page_images(spark, images), P.by_name(P.RECOGNISERS, recogniser)(), **options)


def _translate(spark: SparkSession, translator: str, terms: str | None, **options) -> dict[str, dict[str, int]]:
    return translate_source(spark, call=P.by_name(P.TRANSLATORS, translator), terms=T.read_terms(spark, terms).first()["terms"] if terms else "", **options)


#: Options of each command: required ones end in "!", those with numbers in "#", lists in "*", switches in "?".
OPTIONS = {
    "recognise": (_recognise, recognise.__doc__, "images! folder! recogniser start# end# force?"),
    "translate": (_translate, translate_source.__doc__, "folder! source-language! languages* translator terms start# end# force?"),
    "upload": (upload, upload.__doc__, "folder! pages! sources! chunks"),
    "chunks": (build_chunks, build_chunks.__doc__, "pages! chunks! provider budget# tokenizer"),
    "ask": (ask, ask.__doc__, "pages! chunks! provider question. hybrid? n#"),
    "run-all": (run_all, run_all.__doc__, "images! folder! pages! sources! chunks! source-language! languages* recogniser translator provider tokenizer"),
}
DEFAULTS = {"recogniser": "offline", "translator": "offline", "provider": "offline", "start": 1, "end": None, "budget": chunking.BUDGET, "n": 5}


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="folioscope.jobs", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for command, (_, doc, options) in OPTIONS.items():
        p = commands.add_parser(command, help=doc.splitlines()[0].replace("%", "%%"))
        for option in options.split():
            name = option.rstrip("!#*?.")
            known = {"default": DEFAULTS.get(name)}
            match option.removeprefix(name):
                case ".":
                    p.add_argument(name)
                case "?":
                    p.add_argument(f"--{name}", action="store_true")
                case "#":
                    p.add_argument(f"--{name}", type=int, **known)
                case "*":
                    p.add_argument(f"--{name}", nargs="+", required=True)
                case "!":
                    p.add_argument(f"--{name}", required=True)
                case _:
                    p.add_argument(f"--{name}", **known)
    got = vars(parser.parse_args(args))
    job = OPTIONS[got.pop("command")][0]
    print(json.dumps(job(session("job"), **got), ensure_ascii=False, default=str))


if __name__ == "__main__":
    main()
