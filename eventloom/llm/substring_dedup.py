"""Substring dedup with repeated-phrase automata (words).

The frame in `repeats` finds recurring anchors over all documents and routes the contexts
around them to shards. In a shard the recurring passages are confirmed literally: each window of
words counts once for every occurrence of its context, and runs of windows with a count above
one are passages. The passages of a shard are compiled into an Aho-Corasick automaton
(pyahocorasick), as many at a time as AUTOMATON_BYTES allows, and all contexts of the shard are
streamed through it; every occurrence that the automaton locates is covered. Every document
goes through both passes of the frame: what of it can hold a recurring passage is in some context, and
every context passes an automaton (equal contexts together, once), so all occurrences are located.

Defined results: null texts have no words; windows do not cross documents; repeated rows are
occurrences of their own, so a row that is there twice loses every word that a window covers;
a text shorter than a window keeps all its words; an empty table gives no rows; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from eventloom.llm.repeats import Kind, context_units, groups_of, remove_repeats, runs, spans_batch

WINDOW, GRAM = 35, 8
#: Bytes of contexts whose passages share an automaton.
AUTOMATON_BYTES = 1 << 20


def _automata(batches: Iterator[pa.RecordBatch], kind: Kind) -> Iterator[pa.RecordBatch]:
    for several, single in groups_of(batches, AUTOMATON_BYTES):
        rows = several + single
        count: Counter[bytes] = Counter()
        cut = []
        for _, ctx, n in rows:
            s, e = context_units(ctx, kind)
            wins = [ctx[a:z] for a, z in zip(s[: len(s) - kind.length + 1].tolist(), e[kind.length - 1 :].tolist(), strict=True)]
            cut.append((s, e, wins))
            for w in wins:
                count[w] += n
        machine, any_passage = ahocorasick.Automaton(), False
        for (_, ctx, _), (s, e, wins) in zip(rows, cut, strict=True):
            for a, z in runs(np.flatnonzero([count[w] > 1 for w in wins]), 1):  # windows that follow each other
                passage = " " + ctx[s[a] : e[z + kind.length - 2]].decode("latin-1") + " "
                machine.add_word(passage, len(passage))
                any_passage = True
        if not any_passage:
            continue
        machine.make_automaton()
        out = []
        for (ck, ctx, _), (s, e, _) in zip(rows, cut, strict=True):
            spans = []
            for end, size in machine.iter(" " + ctx.decode("latin-1") + " "):
                # both ends count the space put before the context
                spans.append((int(np.searchsorted(s, end - size + 1)), int(np.searchsorted(e, end - 1)) + 1))
            if spans:
                out.append((ck, sorted(set(spans))))
        yield spans_batch(out)


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, kept_sha256 (and kept, the words that are left, if asked for)."""
    return remove_repeats(docs, Kind("word", window, gram), _automata, text).withColumnRenamed("n", "n_words")
