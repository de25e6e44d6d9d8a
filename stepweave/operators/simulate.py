"""Simulated haplotypes and reads: walks through the graph, their sequences, and reads with errors, drawn from seeds."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

BASES = "ACGT"
NOISE = 0.05  # share of a module walk's choices that take the other module's node


def cycling_nodes(nodes: DataFrame) -> tuple:
    """The nodes of class cyc_l and cyc_r."""
    rows = {r["class"]: r["node"] for r in nodes.filter("class in ('cyc_l', 'cyc_r')").select("class", "node").collect()}  # two rows
    return rows.get("cyc_l"), rows.get("cyc_r")


def module_walk(after: dict, kind: dict, start_module: str, left, right, seed: int, alt_paths: dict | None = None, fusions: set | None = None, noise: float = NOISE, protected: set | None = None) -> list:
    """Nodes from `left` to `right` along a module: after gives each node's successors, kind their classes.

    A walk takes the successor of its own module, or by chance (noise) one of the other's, else the last shared one, else the first. At a node of
    alt_paths it goes on along that path; at a node of fusions it changes modules first. The c2 copies of protected nodes take no noise. Raises an
    error where it finds no successor or runs in circles.
    """
    draw, module, path = random.Random(seed), start_module, [left]
    most = 10 * (len(after) + sum(map(len, (alt_paths or {}).values())) + 1)
    turned = lambda m: "c1" if m == "c2" else "c2"
    while path[-1] != right:
        node = path[-1]
        if node in (alt_paths or {}):
            path += alt_paths[node][1:]
            continue
        if node in (fusions or ()):
            module = turned(module)
        noisy, options, chosen = draw.random() < noise, after.get(node, []), None
        guarded = node in (protected or ())
        if not options or len(path) > most:
            raise ValueError(f"no way from {node} to {right}")
        own = [n for n in options if kind[n] == module]
        other = [n for n in options if kind[n] == turned(module)]
        if own and (not noisy or guarded):
            chosen = own[0]
        elif other and noisy and (module == "c1" or not guarded):
            chosen = other[0]
        else:
            chosen = next((n for n in reversed(options) if kind[n] not in ("c1", "c2")), options[0])
        path.append(chosen)
    return path


def haplotype(flank_left: list, modules: list[list], buffer: list, flank_right: list) -> list:
    """One path: the left flank, modules with the buffer between them, the right flank."""
    out = list(flank_left)
    for k, m in enumerate(modules):
        out += [*(buffer if k else []), *m]
    return out + list(flank_right)


def path_sequence(path: list, seqs: dict, same_sense: dict, first: str = ">") -> str:
    """The bases of a path; a node is reversed and complemented where its edge turns the strand. same_sense: (src, dst) to whether the strand stays."""
    strand, out = first, []
    flip = str.maketrans("ACGTN", "TGCAN")
    for k, n in enumerate(path):
        if k and not same_sense.get((path[k - 1], n), True):
            strand = "<" if strand == ">" else ">"
        out.append(seqs[n] if strand == ">" else seqs[n][::-1].translate(flip))
    return "".join(out)


def mutated(seq: str, draw: np.random.Generator, substitutions: float, indels: float) -> str:
    """seq with substitutions by another base, and half the indels deletions of two to seven bases after one, half insertions of as many."""
    out, skip = [], 0
    for base, x, y in zip(seq, draw.random(len(seq)), draw.random(len(seq))):
        if skip:
            skip -= 1
        elif x < substitutions:
            out.append(str(draw.choice([b for b in BASES if b != base])))
        elif y < indels:
            n = int(draw.integers(2, 8))
            if draw.random() < 0.5:
                skip = n
            else:
                out.append(base + "".join(draw.choice(list(BASES), n)))
        else:
            out.append(base)
    return "".join(out)


def reads(spark: SparkSession, haplotypes: dict[str, str], length: tuple[int, int] = (10_000, 20_000), depth: float = 10, seed: int = 1, mutations: float = 1e-5, substitutions: float = 0.01, indels: float = 0.001) -> DataFrame:
    """name, seq, qual: reads of each haplotype (name to sequence) to about `depth`, half of them reversed and complemented.

    Each haplotype is mutated once, from the seed and its name. A read's length, place, strand and errors come from the seed and its number alone, so
    that any task makes the same ones again. As many reads are drawn as their mean length needs. Lengths are cut to the haplotype's.
    """
    drawn = {h: mutated(s, np.random.default_rng([seed, *h.encode()]), mutations, mutations) for h, s in sorted(haplotypes.items())}
    mean = max((length[0] + length[1]) / 2, 1)
    plan = [(h, k) for h, s in drawn.items() for k in range(int(np.ceil(len(s) * depth / min(mean, max(len(s), 1)))))] if drawn else []
    counts = {h: sum(p[0] == h for p in plan) for h in drawn}
    names, ends = list(counts), np.cumsum([counts[h] for h in counts])
    shared = spark.sparkContext.broadcast(drawn)

    def make(batches):
        for pdf in batches:
            out = []
            for i in pdf["id"]:
                k = int(np.searchsorted(ends, i, "right"))
                h, seq, draw = names[k], shared.value[names[k]], np.random.default_rng([seed, k, int(i)])
                n = min(int(draw.integers(length[0], length[1] + 1)), len(seq))
                at = int(draw.integers(0, len(seq) - n + 1))
                read = mutated(seq[at : at + n], draw, substitutions, indels)
                if draw.random() < 0.5:
                    read = read[::-1].translate(str.maketrans("ACGTN", "TGCAN"))
                out.append((f"{h}_{int(i) - int(ends[k] - counts[h])}", read, "~" * len(read)))
            yield pd.DataFrame(out, columns=["name", "seq", "qual"])

    return spark.range(int(ends[-1]) if len(ends) else 0).mapInPandas(make, "name string, seq string, qual string")
