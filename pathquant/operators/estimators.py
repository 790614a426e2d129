"""Estimators on one cluster, as dense arrays: probs (reads x paths), noise (reads), counts (reads).

They run inside functions over batches, a cluster at a time; ``em_converged`` is expectation-maximisation for clusters
that are too large for one worker, ``em_frames`` a fixed number of its rounds.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import chain, combinations_with_replacement, islice

import numpy as np
from pyspark.sql import DataFrame

from pathquant import config as C
from pathquant.functions.mathfn import permutations


#: Combinations of other than two paths of one cluster that are all listed. Of more, all are weighed, and those listed that
#: have LISTED_CUT of the best likelihood: the others' posteriors are below any output threshold.
LISTED, LISTED_CUT = 5_000_000, 1e-12
FEW_CELLS = 200  # cells of rows that are merged as lists
GROUP_CELLS = 1 << 21  # reads by combinations weighed at a time
KNOWN_CELLS = 10_000_000  # of conditional distributions that a sampler keeps
CHAINS, DRAWS, SAMPLES = 1, 2, 3  # what a random stream of a cluster is for


def with_noise(probs: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Rows scaled to 1 - noise, the noise as last column."""
    total = probs.sum(axis=1, keepdims=True)
    scaled = np.divide(probs, total, out=np.zeros_like(probs), where=total > 0) * (1 - noise)[:, None]
    return np.column_stack([scaled, noise])


def leaders(rows: np.ndarray, precision: float) -> np.ndarray:
    """For rows in lexicographic order the row that each is merged into: the last one that began a class, if all cells are
    nearer to its than the precision, else itself."""
    near = np.zeros(len(rows), bool)
    for low in range(1, len(rows), 4096):
        part = rows[low - 1 : low + 4096]
        near[low : low + 4096] = (np.abs(part[1:] - part[:-1]) < precision).all(axis=1)
    if not near.any():
        return np.arange(len(rows))
    out = list(range(len(rows)))
    for i, same in enumerate(near.tolist()):
        first = out[i - 1] if i else 0
        if first < i and (same if first == i - 1 else (np.abs(rows[i] - rows[first]) < precision).all()):
            out[i] = first
    return np.array(out)


def _lexicographic(rows: np.ndarray) -> np.ndarray:
    """The order of rows of numbers of 0 or more: the bytes of such numbers, highest first, sort as they do."""
    flat = np.ascontiguousarray(rows + 0.0, dtype=">f8")
    return np.argsort(flat.view(np.dtype((np.void, flat.shape[1] * 8))).ravel(), kind="stable") if flat.size else np.arange(len(rows))


@lru_cache(maxsize=64)
def _weights(columns: int) -> np.ndarray:
    return np.random.default_rng(columns).integers(1 << 62, size=columns, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _few(rows: list[list[float]], counts: list[float], precision: float) -> tuple[np.ndarray, np.ndarray]:
    """``collapse_reads`` on lists, which are quicker than arrays for a few cells."""
    kept: list[list[float]] = []
    sums: list[float] = []
    for row, n in sorted(zip(rows, counts)):
        if kept and all(abs(a - b) < precision for a, b in zip(kept[-1], row)):
            sums[-1] += n
        else:
            kept.append(row)
            sums.append(n)
    return np.array(kept), np.array(sums)


def _classes(matrix: np.ndarray, precision: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows that stand for classes of rows equal to the precision, and the class of each row. Equal rows are found by a hash, then compared."""
    cells = np.ascontiguousarray(matrix + 0.0).view(np.uint64)
    mixed = cells ^ (cells >> np.uint64(29))
    _, first, which = np.unique((mixed * _weights(matrix.shape[1])).sum(axis=1, dtype=np.uint64), return_index=True, return_inverse=True)
    which = which.ravel()
    if len(first) < len(cells) and any((cells[low : low + 4096] != cells[first[which[low : low + 4096]]]).any() for low in range(0, len(cells), 4096)):
        first, which = np.arange(len(cells)), np.arange(len(cells))
    order = _lexicographic(matrix[first])
    led = leaders(matrix[first[order]], precision)
    kept, own = np.unique(led, return_inverse=True)
    of = np.empty(len(order), np.int64)
    of[order] = own.ravel()
    return first[order[kept]], of[which]


def collapse_reads(matrix: np.ndarray, counts: np.ndarray, precision: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are equal within the precision become one: the first of them in lexicographic order, with their counts."""
    if len(matrix) < 2:
        return matrix, counts
    if matrix.size <= FEW_CELLS:
        return _few(matrix.tolist(), counts.tolist(), precision)
    kept, which = _classes(matrix, precision)
    return matrix[kept], np.bincount(which, weights=counts)


def collapse_paths(matrix: np.ndarray, precision: float = 1e-8) -> tuple[np.ndarray, list[list[int]]]:
    """Columns that are equal within the precision become one; returns the matrix and the members of each column."""
    kept, which = _classes(np.ascontiguousarray(matrix.T), precision)
    members: list[list[int]] = [[] for _ in kept]
    for column, group in enumerate(which.tolist()):
        members[group].append(column)
    return matrix[:, kept], members


def without_noise(probs: np.ndarray, noise: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows normalised to 1 and counts scaled by 1 - noise; rows that are all noise go."""
    live = noise < 1
    total = probs[live].sum(axis=1, keepdims=True)
    return np.divide(probs[live], total, out=np.zeros_like(probs[live]), where=total > 0), counts[live] * (1 - noise[live])


def _dense_step(matrix: np.ndarray, weights: np.ndarray):
    def step(share):
        norm = matrix @ share
        norm[norm == 0] = np.inf
        return (weights / norm) @ matrix

    return step


def _sparse_step(matrix: np.ndarray, weights: np.ndarray):
    """The same over the cells that are not 0; every row has one."""
    rows, columns = np.nonzero(matrix)
    cells, starts, n = matrix[rows, columns], np.searchsorted(rows, np.arange(len(matrix))), matrix.shape[1]

    def step(share):
        norm = np.add.reduceat(cells * share[columns], starts)
        norm[norm == 0] = np.inf
        return np.bincount(columns, cells * (weights / norm)[rows], minlength=n)

    return step


SMALL_CELLS = 48  # cells up to which plain numbers are quicker than arrays


def _small_em(rows: list[list[float]], weights: list[float], share: list[float], max_its: int, tolerance: float) -> list[float]:
    """The rounds of ``em`` on lists."""
    columns, calm = range(len(share)), 0
    for _ in range(max_its):
        mass = [0.0] * len(share)
        for row, weight in zip(rows, weights):
            joint = [c * s for c, s in zip(row, share)]
            norm = sum(joint)
            if norm > 0:
                part = weight / norm
                for j in columns:
                    mass[j] += joint[j] * part
        calm += 1
        for a, b in zip(share, mass):
            if b >= C.EM_MIN_ABUNDANCE and abs(b - a) > tolerance * b:
                calm = 0
                break
        share = mass
        if calm == C.EM_CONVERGED_ROUNDS:
            break
    return share


def em(matrix: np.ndarray, counts: np.ndarray, max_its: int = 10_000, tolerance: float = 0.001) -> tuple[np.ndarray, float]:
    """Expected counts of the paths and of noise (last column), by expectation-maximisation."""
    n, total = matrix.shape[1], counts.sum()
    if total == 0:
        return np.zeros(n - 1), 0.0
    live = matrix.any(axis=1)
    matrix, weights = matrix[live], counts[live] / total
    share = np.full(n, float(np.float32(1 / n)))
    if matrix.size <= SMALL_CELLS:
        share = np.array(_small_em(matrix.tolist(), weights.tolist(), share.tolist(), max_its, tolerance))
        max_its = 0
    step = _sparse_step(matrix, weights) if matrix.size > 100_000 and np.count_nonzero(matrix) < 0.2 * matrix.size else _dense_step(matrix, weights)
    calm = 0
    for _ in range(max_its):
        before = share
        share = share * step(share)
        moved = (np.abs(share - before) > tolerance * share) & (share >= C.EM_MIN_ABUNDANCE)
        calm = 0 if moved.any() else calm + 1
        if calm == C.EM_CONVERGED_ROUNDS:
            break
    tiny = share[:-1] < C.EM_MIN_ABUNDANCE
    noise = share[-1] + share[:-1][tiny].sum()
    return np.where(tiny, 0.0, share[:-1]) * total, noise * total


def em_frames(probs: DataFrame, rounds: int) -> DataFrame:
    """EM for any size of cluster: (cluster_id, path_id, share) after a fixed number of rounds; path_id null is noise.

    probs: (cluster_id, read_class_id, read_count, noise_prob, path_id, prob) normalised, as blocks of arrays (``packed``).
    """
    from pathquant.operators import packed

    blocks, items = packed.packed(probs)
    return packed.named(packed.em_shares(blocks, rounds, None), items)


def em_converged(probs: DataFrame, max_its: int, tolerance: float) -> DataFrame:
    """EM for any size of cluster until its shares are calm: (cluster_id, path_id, share); path_id null is noise.

    A cluster that is calm for EM_CONVERGED_ROUNDS rounds keeps its shares and takes part in no further round. A cluster
    of one block of cells is settled in one task; a round of larger ones is a job.
    """
    from pathquant.operators import packed

    blocks, items = packed.packed(probs)
    return packed.named(packed.em_shares(blocks, max_its, tolerance), items)


def gibbs_counts(matrix: np.ndarray, counts: np.ndarray, start: np.ndarray, rng: np.random.Generator, samples: int, thin: int) -> tuple[np.ndarray, np.ndarray]:
    """Samples of read counts (samples x paths) and of noise, from the posterior of the shares. start: shares with noise last."""
    whole = counts.astype(np.int64)
    share, total = start / start.sum(), counts.sum()
    paths, noise = [], []
    for i in range(samples * thin):
        joint = matrix * share
        norm = joint.sum(axis=1, keepdims=True)
        live = norm[:, 0] > 0
        drawn = rng.multinomial(whole[live], joint[live] / norm[live]).sum(axis=0)
        share = rng.gamma(drawn + C.GIBBS_GAMMA_PRIOR, 1.0)
        share /= share.sum()
        if (i + 1) % thin == 0:
            tiny = share[:-1] < C.GIBBS_MIN_ABUNDANCE
            paths.append(np.where(tiny, 0.0, share[:-1]) * total)
            noise.append((share[-1] + share[:-1][tiny].sum()) * total)
    return np.array(paths).reshape(len(noise), matrix.shape[1] - 1), np.array(noise)


def _log_frequencies(sources: np.ndarray) -> np.ndarray:
    return np.log(sources / sources.sum())


def _every_group(probs, noise, counts, freq, size: int, exact: bool, floor: float) -> tuple[list[tuple[int, ...]], np.ndarray, float]:
    """All multisets of ``size`` paths with their log weights, and the log of the summed weight of those that are not listed."""
    n = probs.shape[1]
    if math.comb(n + size - 1, size) > LISTED:
        floor = max(floor, math.log(LISTED_CUT))
    orders = np.log([1.0, *(math.factorial(size) / math.factorial(size - u + 1) for u in range(1, size + 1))])
    combos, step = combinations_with_replacement(range(n), size), max(1, GROUP_CELLS // max(1, len(probs)))
    kept, top, unlisted = [], -math.inf, -math.inf
    while True:
        chunk = np.fromiter(chain.from_iterable(islice(combos, step)), dtype=np.int64).reshape(-1, size)
        if not len(chunk):
            break
        with np.errstate(divide="ignore"):
            value = counts @ np.log(noise[:, None] + sum(probs[:, chunk[:, k]] for k in range(size)) / size)
        distinct = 1 + (chunk[:, 1:] != chunk[:, :-1]).sum(axis=1)
        value += freq[chunk].sum(axis=1) + ([math.log(permutations(g, True)) for g in chunk.tolist()] if exact else orders[distinct])
        top = max(top, value.max())
        keep = value >= top + floor
        unlisted = np.logaddexp.reduce(np.append(value[~keep], unlisted))
        kept.append((chunk[keep], value[keep]))
    groups, values = (np.concatenate(x) for x in zip(*kept))
    keep = values >= top + floor
    unlisted = np.logaddexp.reduce(np.append(values[~keep], unlisted))
    return [tuple(g) for g in groups[keep].tolist()], values[keep], float(unlisted)


def group_posteriors(probs: np.ndarray, noise: np.ndarray, counts: np.ndarray, sources: np.ndarray, size: int, cut: float = 0.0, exact: bool = False) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """Posteriors of all multisets of ``size`` paths. With cut, those below cut times the best likelihood are left out.

    For pairs, rows of the likelihood table are made one first member at a time, which bounds the memory, and a
    first member whose upper bound (its best partner at every read) is below the cut is skipped.
    """
    freq = _log_frequencies(sources)
    floor = math.log(cut) if cut > 0 else -math.inf
    if size == 2:
        n = probs.shape[1]
        with np.errstate(divide="ignore"):
            bound = counts @ np.log(noise[:, None] + (probs + probs.max(axis=1, keepdims=True)) / 2) + freq + math.log(2)
        kept: list[tuple[float, tuple[int, int]]] = []
        top = -math.inf
        for i in np.argsort(-bound):
            if bound[i] < top + floor:
                break
            partners = np.arange(n)
            with np.errstate(divide="ignore"):
                like = counts @ np.log(noise[:, None] + (probs[:, [i]] + probs[:, partners]) / 2) + freq[i] + freq + np.where(partners == i, 0.0, math.log(2))
            top = max(top, like.max())
            kept += [(value, (min(i, j), max(i, j))) for j, value in enumerate(like.tolist()) if value >= top + floor]
        best = {g: v for v, g in kept if v >= top + floor}
        groups = sorted(best)
        values = np.array([best[g] for g in groups])
    else:
        groups, values, unlisted = _every_group(probs, noise, counts, freq, size, exact, floor)
        weight = np.exp(values - values.max())
        return groups, weight / (weight.sum() + math.exp(unlisted - values.max()))
    weight = np.exp(values - values.max())
    return [tuple(int(x) for x in g) for g in groups], weight / weight.sum()


def stream(*key: int) -> np.random.Generator:
    """Random numbers of a counter-based generator: those of one key (seed, cluster, chain, ...) are the same in any task and any order."""
    words = np.random.SeedSequence([k & 0xFFFFFFFFFFFFFFFF for k in key]).generate_state(2, np.uint64)
    return np.random.Generator(np.random.Philox(key=words))


def gibbs_schedule(paths: int, size: int) -> tuple[int, int, int]:
    """Chains, iterations of burn-in and counted iterations of the haplotype sampler."""
    return tuple(int(base + per * size * paths) for base, per in (C.GIBBS_CHAINS, C.GIBBS_BURN_IN, C.GIBBS_ITERATIONS))


def gibbs_chains(probs: np.ndarray, noise: np.ndarray, counts: np.ndarray, sources: np.ndarray, size: int, chains, randoms) -> dict[tuple[int, ...], int]:
    """How often each multiset of paths occurs in some chains of Gibbs samples: each slot in turn given the others.

    chains: their numbers; randoms(chain): the generator of a chain, from which all that it needs is drawn.
    """
    freq = _log_frequencies(sources)

    def conditional(others: tuple[int, ...]) -> np.ndarray:
        rest = noise + probs[:, list(others)].sum(axis=1) / size
        with np.errstate(divide="ignore"):
            return counts @ np.log(rest[:, None] + probs / size) + freq

    return gibbs_walk(probs.shape[1], size, conditional, chains, randoms)


def gibbs_walk(n: int, size: int, conditional, chains, randoms) -> dict[tuple[int, ...], int]:
    """``gibbs_chains`` over n paths. conditional(others): log weights of all paths for a slot, given the paths of the other ones."""
    _, burn, its = gibbs_schedule(n, size)
    seen: dict[tuple, int] = {}
    known: dict[tuple, np.ndarray] = {}
    for chain in chains:
        rng = randoms(chain)
        slots = rng.integers(0, n, size).tolist()
        for i, row in enumerate(rng.random((burn + its, size))):
            for k in range(size):
                others = tuple(sorted(slots[:k] + slots[k + 1 :]))
                if others not in known:
                    if len(known) * n > KNOWN_CELLS:
                        known.clear()
                    like = conditional(others)
                    known[others] = np.cumsum(np.exp(like - like.max()))
                sums = known[others]
                slots[k] = min(n - 1, int(np.searchsorted(sums, row[k] * sums[-1], side="right")))
            if i >= burn:
                key = tuple(sorted(slots))
                seen[key] = seen.get(key, 0) + 1
    return seen


def gibbs_posteriors(probs: np.ndarray, noise: np.ndarray, counts: np.ndarray, sources: np.ndarray, size: int, randoms) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """Posteriors of multisets as frequencies of Gibbs samples; see ``gibbs_chains``."""
    chains, _, its = gibbs_schedule(probs.shape[1], size)
    seen = gibbs_chains(probs, noise, counts, sources, size, range(chains), randoms)
    groups = sorted(seen)
    return groups, np.array([seen[g] / (chains * its) for g in groups])


def min_path_cover(cover: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> list[int]:
    """Paths that cover all reads, each time the one with most uncovered count to its weight; ties to the first."""
    if cover.shape[1] == 1:
        return [0]
    open_ = np.where(cover.any(axis=1), counts, 0).astype(float)
    cover = cover.astype(float)
    chosen: list[int] = []
    while open_.sum() > 0:
        gain = open_ @ cover
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = gain / weights
        ratio[np.isnan(ratio)] = -1.0
        best = int(np.argmax(ratio))
        if gain[best] <= 0:
            break
        chosen.append(best)
        open_[cover[:, best] > 0] = 0
    return sorted(chosen)


def strains(probs: np.ndarray, noise: np.ndarray, counts: np.ndarray, max_its: int, tolerance: float, precision: float = 1e-8) -> tuple[np.ndarray, float, np.ndarray, list[int]]:
    """Counts of all paths (0 outside the cover), noise, and what the count sampler needs: the matrix's shares and the cover.

    Reads that are all noise count as noise.
    """
    matrix = with_noise(probs, noise)
    live = noise < 1 - 1e-12
    counted = np.where(live, counts, 0.0)
    path_part = matrix[:, :-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        logs = np.where(path_part > 0, np.log(path_part), 0.0)
    weights = 0.0 - (logs * counted[:, None]).sum(axis=0)  # 0, not -0, where every probability is 1
    chosen = min_path_cover(path_part > 0, counted, weights)
    out = np.zeros(probs.shape[1])
    if not chosen:
        return out, float(counts.sum()), np.zeros(1), []
    own, own_counts = collapse_reads(with_noise(probs[:, chosen], noise), counts, precision)
    found, lost = em(own, own_counts, max_its, tolerance)
    out[chosen] = found
    return out, lost, own, chosen


def source_groups(sources: list[list]) -> tuple[list[list[int]], np.ndarray]:
    """Haplotypes with equal lists of paths as one group, with their number."""
    by_source: dict = {}
    for path, own in enumerate(sources):
        for s in own:
            by_source.setdefault(s, []).append(path)
    groups: dict[tuple, int] = {}
    for members in by_source.values():
        groups[tuple(members)] = groups.get(tuple(members), 0) + 1
    keys = sorted(groups)
    return [list(k) for k in keys], np.array([groups[k] for k in keys], dtype=float)


def select_subsets(groups: list[tuple[int, ...]], posteriors: np.ndarray, members: list[list[int]], min_prob: float) -> dict[tuple[int, ...], float]:
    """Path subsets of the group sets with at least min_prob, equal ones summed, normalised."""
    out: dict[tuple[int, ...], float] = {}
    for g, p in zip(groups, posteriors):
        if p >= min_prob:
            subset = tuple(sorted(path for x in g for path in members[x]))
            out[subset] = out.get(subset, 0.0) + float(p)
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


def subset_abundances(probs, noise, counts, group_ids, subsets: dict, settings: C.EngineConfig, rng) -> dict:
    """EM in every subset, weighted by its probability; paths regrouped by transcript.

    Returns groups {(paths): [probability, counts]}, noise, and samples [(paths, counts, noise)].
    """
    total = float(counts.sum())
    out: dict[tuple, list] = {}
    lost, used, samples = 0.0, 0.0, []
    left, left_prob = settings.num_gibbs_samples, 1.0
    for subset, weight in sorted(subsets.items()):
        if weight < settings.min_hap_prob:
            continue
        used += weight
        distinct = sorted(set(subset))
        copies = {p: subset.count(p) for p in distinct}
        matrix, merged = collapse_reads(with_noise(probs[:, distinct], noise), counts, settings.prob_precision)
        found, gone = em(matrix, merged, settings.max_em_its, settings.max_rel_em_conv)
        lost += gone * weight
        if left > 0:
            n = int(rng.binomial(left, min(1.0, max(0.0, weight / left_prob)))) if left_prob > 0 else left
            left, left_prob = left - n, left_prob - weight
            if n:
                samples.append((distinct, *gibbs_counts(matrix, merged, np.append(found, gone), rng, n, settings.gibbs_thin_its)))
        at = dict(zip(distinct, found))
        by_group: dict = {}
        for p in subset:
            by_group.setdefault(group_ids[p], []).append(p)
        for own in by_group.values():
            entry = out.setdefault(tuple(own), [0.0, np.zeros(len(own))])
            entry[0] += weight
            entry[1] += np.array([at[p] / copies[p] for p in own]) * weight
    return {"groups": out, "noise": lost + max(0.0, 1 - used) * total, "samples": samples}


def independent_draws(seed: int, cluster: int, group: int, posteriors: np.ndarray, draws: int) -> np.ndarray:
    """Draws of combinations of a transcript's paths, by number."""
    return stream(seed, int(cluster), DRAWS, int(group)).choice(len(posteriors), size=draws, p=posteriors / posteriors.sum())


def nested(probs, noise, counts, group_ids, sources: list[list], settings: C.EngineConfig, cluster: int) -> dict:
    """Haplotype combinations first, then abundances in each likely path subset."""
    size = settings.ploidy
    rng = stream(settings.seed, cluster, DRAWS) if settings.num_gibbs_samples else None

    def posteriors(p, n, c, freq, cut, group=0):
        if settings.use_hap_gibbs:
            return gibbs_posteriors(p, n, c, freq, size, lambda chain: stream(settings.seed, cluster, CHAINS, group, chain))
        return group_posteriors(p, n, c, freq, size, cut if size == 2 else 0.0, settings.exact_permutations)

    if settings.ind_hap_inference:
        # every transcript by itself; then joint draws over transcripts
        draws = int(1 / settings.min_hap_prob)
        picked: list[list[int]] = [[] for _ in range(draws)]
        for g in sorted(set(group_ids)):
            own = [i for i, x in enumerate(group_ids) if x == g]
            matrix, merged = collapse_reads(with_noise(probs[:, own], noise), counts, settings.prob_precision)
            freq = np.array([max(1, len(sources[i])) for i in own], dtype=float)
            groups, post = posteriors(matrix[:, :-1], matrix[:, -1], merged, freq, settings.min_hap_prob, int(g))
            for slot, k in zip(picked, independent_draws(settings.seed, cluster, g, post, draws)):
                slot += [own[x] for x in groups[k]]
        subsets: dict = {}
        for slot in picked:
            key = tuple(sorted(slot))
            subsets[key] = subsets.get(key, 0.0) + 1 / draws
    else:
        members, freq = source_groups(sources)
        summed = np.column_stack([probs[:, m].sum(axis=1) for m in members])
        matrix, merged = collapse_reads(with_noise(summed, noise), counts, settings.prob_precision)
        groups, post = posteriors(matrix[:, :-1], matrix[:, -1], merged, freq, settings.min_hap_prob)
        subsets = select_subsets(groups, post, members, settings.min_hap_prob)
    return subset_abundances(probs, noise, counts, group_ids, subsets, settings, rng)
