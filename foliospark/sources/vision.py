"""The pluggable image stage: images in, OCR documents out; the engine is made once per worker."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

_engines: dict[str, object] = {}


def ocr(images: DataFrame, make_engine: Callable[[], Callable[[bytes], str]], key: str = "default") -> DataFrame:
    """path and the engine's JSON for each image; an image that fails has its error instead."""

    def run(batches):
        for batch in batches:
            engine = _engines.get(key) or _engines.setdefault(key, make_engine())
            out, error = [], []
            for content in batch["content"]:
                try:
                    out.append(engine(content))
                    error.append(None)
                except Exception as e:  # one broken image must not end the others
                    out.append(None)
                    error.append(type(e).__name__)
            yield batch[["path"]].assign(ocr_json=out, error=error)

    return images.select("path", "content").mapInPandas(run, "path string, ocr_json string, error string")
