"""Forward passes of the learned operators that have a shape of their own, as NumPy functions over one item or a batch.

Parameters are dictionaries of arrays (a model, not data); `operators/kernels.py: per_row` and `operators/neural.py:
apply_model` run them over tables. Relational parts (edges, features by join) are expressions in `operators/network.py`.
"""

from __future__ import annotations

import numpy as np

from strandlake.operators.neural import conv1d, layer_norm, mlp, relu, seeded, softmax, transformer_block, vae_encode


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def one_hot(text: str, alphabet: str = "ACGT", unknown: float | None = None) -> np.ndarray:
    """(length, letters); a letter outside the alphabet is a uniform row, or one of the value `unknown`."""
    rows = np.eye(len(alphabet))
    other = np.full(len(alphabet), 1 / len(alphabet) if unknown is None else unknown)
    at = {c: rows[i] for i, c in enumerate(alphabet)}
    return np.array([at.get(c, other) for c in text]).reshape(len(text), len(alphabet))


def dense(seed: int, *widths: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Seeded dense layers."""
    return [(seeded(seed + i, a, b), np.zeros(b)) for i, (a, b) in enumerate(zip(widths, widths[1:]))]


# Reads
def correct_errors(bases: np.ndarray, quality: np.ndarray, layers, half: int = 2) -> np.ndarray:
    """Base distributions: what a dense net predicts from the window of bases and qualities, mixed with the read by its quality."""
    n = len(bases)
    feature = np.concatenate([bases, quality[:, None] / 40], axis=1)
    at = np.clip(np.arange(n)[:, None] + np.arange(-half, half + 1), 0, max(n - 1, 0))
    predicted = softmax(mlp(feature[at].reshape(n, -1), layers)) if n else np.zeros((0, bases.shape[1]))
    sure = 1 - 10 ** (-quality / 10)
    return sure[:, None] * bases + (1 - sure[:, None]) * predicted


def map_read(read: np.ndarray, reference: np.ndarray, params: dict) -> tuple[np.ndarray, int, float]:
    """(probability of each reference position, best position, mapping quality) of one read by cross attention.

    Quality: one minus the entropy share of the positions, times a learned confidence.
    """
    q, k = read @ params["q"], reference @ params["k"]
    scores = (q @ k.T / np.sqrt(q.shape[1])).mean(0)
    p = softmax(scores)
    entropy = -(p * np.log(p + 1e-10)).sum() / np.log(max(len(p), 2))
    confidence = sigmoid(float(q.mean(0) @ params["c"]))
    return p, int(p.argmax()), float((1 - entropy) * confidence)


def align_to_anchor(anchor: np.ndarray, sequence: np.ndarray, embed: np.ndarray, temperature: float = 1.0) -> np.ndarray:
    """A sequence laid on the positions of an anchor by attention."""
    return softmax((anchor @ embed) @ (sequence @ embed).T / temperature) @ sequence


def star_alignment(sequences: list[np.ndarray], params: dict, temperature: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(aligned, consensus, distances): every sequence laid on the positions of the first by attention; the mean of all is the consensus."""
    codes = [s @ params["embed"] for s in sequences]
    means = np.array([c.mean(0) for c in codes])
    distances = np.sqrt(((means[:, None] - means[None]) ** 2).sum(-1) + 1e-12)
    aligned = np.array([align_to_anchor(sequences[0], s, params["embed"], temperature) for s in sequences])
    aligned[0] = sequences[0]
    return aligned, aligned.mean(0), distances


def bin_contigs(frequencies: np.ndarray, abundance: np.ndarray, params: dict, temperature: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(latent, bin probabilities) of contigs from k-mer frequencies and abundances: encoder mean, softmax of minus squared distance."""
    x = np.concatenate([frequencies, np.log1p(np.maximum(abundance, 0))], axis=1)
    z = relu(mlp(x, params["encoder"])) @ params["mean"]
    d = ((z[:, None] - params["centres"][None]) ** 2).sum(-1)
    return z, softmax(-d / temperature)


def guide_score(guide: str, params: dict) -> float:
    """Efficiency of a guide: convolution, greatest response of each filter, dense net, sigmoid."""
    x = one_hot(guide, unknown=0.0)
    h = relu(conv1d(x, params["kernel"], params["bias"])).max(0) if len(x) else np.zeros(len(params["bias"]))
    return float(sigmoid(mlp(h[None], params["head"])[0, 0]))


# Variants and signals
def conv2d(x: np.ndarray, kernel: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Same-padded convolution of (rows, columns, channels) with (height, width, channels, out)."""
    kh, kw = kernel.shape[:2]
    p = np.pad(x, ((kh // 2, kh - 1 - kh // 2), (kw // 2, kw - 1 - kw // 2), (0, 0)))
    out = sum(p[i : i + x.shape[0], j : j + x.shape[1]] @ kernel[i, j] for i in range(kh) for j in range(kw))
    return out + bias


def classify_image(image: np.ndarray, params: dict) -> np.ndarray:
    """Genotype probabilities of a pileup image: two convolutions with halving pools, mean over pixels, dense net."""
    x = image
    for k, b in params["convolutions"]:
        x = relu(conv2d(x, k, b))
        h, w = x.shape[0] // 2 * 2, x.shape[1] // 2 * 2
        if h and w:
            x = x[:h, :w].reshape(h // 2, 2, w // 2, 2, -1).max((1, 3))
    return softmax(mlp(x.mean((0, 1))[None], params["head"]))[0]


def fourier_layer(x: np.ndarray, weights: np.ndarray, bypass: np.ndarray) -> np.ndarray:
    """Spectral convolution of (length, channels): the lowest modes by complex weights (modes, in, out), plus a pointwise map."""
    f = np.fft.rfft(x, axis=0)
    modes = min(len(weights), len(f))
    g = np.zeros((len(f), weights.shape[2]), complex)
    g[:modes] = np.einsum("mi,mio->mo", f[:modes], weights[:modes])
    return np.fft.irfft(g, n=len(x), axis=0) + x @ bypass


def fourier_peaks(coverage: np.ndarray, params: dict) -> np.ndarray:
    """Peak probability of each position: lifting, Fourier layers, projection, sigmoid."""
    x = np.asarray(coverage, float)[:, None] @ params["lift"]
    for w, b in params["layers"]:
        x = relu(fourier_layer(x, w, b))
    return sigmoid((x @ params["project"])[:, 0])


def chromatin_states(marks: np.ndarray, initial: np.ndarray, transition: np.ndarray, rates: np.ndarray, temperature: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
    """(posteriors, expected state, log-likelihood) of binary marks (positions, marks) under a Bernoulli hidden Markov model.

    The expected state comes from a soft Viterbi pass: messages by log-sum-exp at a temperature, then softmax of each
    position's best score, whose mean index is reported.
    """
    n, k = len(marks), len(initial)
    if not n:
        return np.zeros((0, k)), np.zeros(0), 0.0
    log_e = marks @ np.log(rates.T) + (1 - marks) @ np.log(1 - rates.T)
    log_t = np.log(transition)

    def add(x, axis):
        top = x.max(axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)

    f, b = np.empty((n, k)), np.zeros((n, k))
    f[0] = np.log(initial) + log_e[0]
    for t in range(1, n):
        f[t] = add(f[t - 1][:, None] + log_t, 0) + log_e[t]
    for t in range(n - 2, -1, -1):
        b[t] = add(log_t + (log_e[t + 1] + b[t + 1])[None], 1)
    total = add(f[-1], 0)
    v, w = np.empty((n, k)), np.zeros((n, k))
    v[0] = f[0]
    for t in range(1, n):
        v[t] = temperature * add((v[t - 1][:, None] + log_t) / temperature, 0) + log_e[t]
    for t in range(n - 2, -1, -1):
        w[t] = temperature * add((log_t + (log_e[t + 1] + w[t + 1])[None]) / temperature, 1)
    return np.exp(f + b - total), softmax((v + w) / temperature) @ np.arange(k), float(total)


# Cells
def doublet_probability(counts: np.ndarray, params: dict) -> np.ndarray:
    """Chance that a profile is a doublet: encoder mean of a count autoencoder, then a classifier."""
    mean, _ = vae_encode(counts, params["encoder"], params["mean"], params["logvar"])
    return sigmoid(mlp(mean, params["head"])[:, 0])


def denoise(values: np.ndarray, mask: np.ndarray, params: dict, heads: int = 2) -> np.ndarray:
    """Masked entries replaced by a transformer's predictions over gene tokens; the others stay."""
    hidden = np.where(mask, 0.0, values)
    x = params["genes"][: len(values)] + hidden[:, None] * params["value"]
    y = layer_norm(transformer_block(x, params["block"], heads)) @ params["out"]
    return np.where(mask, y[:, 0], values)


def edge_attention(nodes: np.ndarray, edges: np.ndarray, features: np.ndarray, params: dict, slope: float = 0.2) -> np.ndarray:
    """Attention over incoming edges, scored from target, source and edge features; messages carry source and edge."""
    n = len(nodes)
    out = np.zeros((n, params["v"].shape[1]))
    if len(edges):
        s, t = edges.T
        z = nodes[t] @ params["left"] + nodes[s] @ params["right"] + features @ params["edge"]
        score = np.where(z > 0, z, slope * z) @ params["a"]
        top = np.full(n, -np.inf)
        np.maximum.at(top, t, score)
        e = np.exp(score - top[t])
        total = np.zeros(n)
        np.add.at(total, t, e)
        np.add.at(out, t, (e / total[t])[:, None] * (nodes[s] @ params["v"] + features @ params["ve"]))
    return out


def attention_block(nodes: np.ndarray, edges: np.ndarray, features: np.ndarray, params: dict) -> np.ndarray:
    """Edge attention with a residual and a norm, then a dense layer with a residual."""
    x = layer_norm(nodes @ params["skip"] + edge_attention(nodes, edges, features, params))
    return x + relu(x @ params["up"]) @ params["down"]


def block_parameters(seed: int, width: int, edge: int, out: int) -> dict:
    shapes = {"left": (width, out), "right": (width, out), "edge": (edge, out), "v": (width, out), "ve": (edge, out), "skip": (width, out), "up": (out, 2 * out), "down": (2 * out, out)}
    return {k: seeded(seed + i, *s) for i, (k, s) in enumerate(shapes.items())} | {"a": seeded(seed + 50, out)}


def pathway_scores(nodes: np.ndarray, edges: np.ndarray, features: np.ndarray, params: dict) -> tuple[np.ndarray, np.ndarray]:
    """(node embeddings, pathway activities) of cells that exchange ligands and receptors."""
    h = attention_block(nodes, edges, features, params["block"])
    return h, sigmoid(mlp(h, params["decoder"]))


def spatial_domains(nodes: np.ndarray, edges: np.ndarray, mutual: np.ndarray, params: dict, alpha: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """(embeddings, domain probabilities): attention over all and over mutual neighbours, mixed, against prototypes."""
    ones = np.ones((len(edges), 1))
    whole = attention_block(nodes, edges, ones, params["whole"])
    kept = edges[mutual.astype(bool)] if len(edges) else edges
    pruned = attention_block(nodes, kept, np.ones((len(kept), 1)), params["pruned"])
    z = (1 - alpha) * whole + alpha * pruned
    return z, softmax(-((z[:, None] - params["prototypes"][None]) ** 2).sum(-1))


def regulatory_matrix(means: np.ndarray, factors: np.ndarray, params: dict, temperature: float = 0.1) -> np.ndarray:
    """(factors, genes) strengths: attention on the bipartite graph of factors and genes, a score per edge, a soft gate at zero."""
    f, g = len(factors), len(means)
    x = np.concatenate([means[factors], means])[:, None] @ params["node"]
    s, t = np.repeat(np.arange(f), g), f + np.tile(np.arange(g), f)
    tf, gene = means[factors][s], means[t - f]
    features = np.stack([tf, gene, np.abs(tf - gene)], axis=1)
    h = attention_block(x, np.stack([s, t], axis=1), features, params["block"])
    raw = (np.concatenate([h[s], h[t]], axis=1) @ params["score"]).reshape(f, g)
    return raw * sigmoid(raw / temperature)


def paste_alignment(expression1, expression2, places1, places2, alpha: float = 0.1, epsilon: float = 0.1, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(plan, places of slice 1 carried to slice 2): expression cost mixed with a Gromov-Wasserstein term at the uniform plan, then Sinkhorn.

    Slices are pieces of tissue: an alignment is one problem of n x m spots.
    """
    n, m = len(expression1), len(expression2)
    square = lambda a, b: ((a[:, None] - b[None]) ** 2).sum(-1)
    d1, d2 = np.sqrt(square(places1, places1) + 1e-12), np.sqrt(square(places2, places2) + 1e-12)
    p, q = np.full(n, 1 / n), np.full(m, 1 / m)
    gw = (d1**2 @ p)[:, None] + (d2**2 @ q)[None] - 2 * d1 @ np.outer(p, q) @ d2.T
    scale = lambda c: c / max(c.max(), 1e-12)
    cost = (1 - alpha) * scale(square(expression1, expression2)) + alpha * scale(gw)
    k, u, v = -cost / epsilon, np.zeros(n), np.zeros(m)

    def lse(x, axis):
        top = x.max(axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)

    for _ in range(rounds):
        u = np.log(p) - lse(k + v[None], 1)
        v = np.log(q) - lse(k + u[:, None], 0)
    plan = np.exp(k + u[:, None] + v[None])
    return plan, (plan / plan.sum(0, keepdims=True)).T @ places1


def ancestry(genotypes: np.ndarray, params: dict, temperature: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, reconstructed genotypes): softmax of an encoder, times twice the allele frequencies."""
    q = softmax(mlp(genotypes / 2, params["encoder"]) / temperature)
    return q, 2 * q @ sigmoid(params["frequencies"])


# Molecules
def stacked_messages(nodes: np.ndarray, edges: np.ndarray, features: np.ndarray, layers: list[dict]) -> np.ndarray:
    """Rounds of edge-conditioned messages summed at targets, with a residual from the second round on."""
    x = nodes
    for k, p in enumerate(layers):
        total = np.zeros((len(x), p["message"].shape[1]))
        if len(edges):
            s, t = edges.T
            np.add.at(total, t, relu(np.concatenate([x[s], features], axis=1) @ p["message"]))
        y = relu(np.concatenate([x, total], axis=1) @ p["update"])
        x = y + x if k and y.shape == x.shape else y
    return x


def graph_fingerprint(nodes, edges, features, params: dict) -> np.ndarray:
    """Sum of the atoms' last states through a dense layer, as a molecule's continuous fingerprint."""
    return np.tanh(stacked_messages(nodes, edges, features, params["layers"]).sum(0) @ params["out"])


def gru(x: np.ndarray, h: np.ndarray, params: dict) -> np.ndarray:
    """One gated recurrent step; gates in the order reset, update, candidate."""
    r, z = sigmoid(x @ params["xr"] + h @ params["hr"]), sigmoid(x @ params["xz"] + h @ params["hz"])
    return (1 - z) * np.tanh(x @ params["xn"] + r * (h @ params["hn"])) + z * h


def attentive_fingerprint(nodes, edges, features, params: dict, steps: int = 2) -> np.ndarray:
    """Atoms by gated edge attention, then a molecule state that attends to its atoms for some gated steps."""
    h = relu(nodes @ params["embed"])
    h = gru(relu(edge_attention(h, edges, features, params["gate"])), h, params["atom"])
    state = relu(h.sum(0))
    for _ in range(steps):
        z = np.concatenate([np.broadcast_to(state, h.shape), h], axis=1) @ params["align"]
        a = softmax(np.where(z > 0, z, 0.2 * z)) if len(h) else z
        state = gru(relu((a[:, None] * (h @ params["value"])).sum(0)), state, params["mol"])
    return state


def gru_parameters(seed: int, width: int) -> dict:
    return {k: seeded(seed + i, width, width) for i, k in enumerate(("xr", "hr", "xz", "hz", "xn", "hn"))}


def predict_properties(fingerprint: np.ndarray, heads: dict[str, list], classify: set[str] = frozenset(), activate: bool = True) -> dict[str, float]:
    """A value for each task's head; classification tasks go through a sigmoid where `activate` is set."""
    out = {}
    for task, layers in heads.items():
        y = float(mlp(fingerprint[None], layers)[0, 0])
        out[task] = float(sigmoid(y)) if activate and task in classify else y
    return out


#: The 22 tasks of the ADMET benchmark group, classification ones second.
ADMET_REGRESSION = ("caco2", "lipophilicity", "solubility", "ppbr", "vdss", "half_life", "clearance_microsome", "clearance_hepatocyte", "ld50")
ADMET_CLASSIFICATION = (
    "hia", "pgp", "bioavailability", "bbb", "cyp2d6_inhibition", "cyp3a4_inhibition", "cyp2c9_inhibition", "cyp2d6_substrate", "cyp3a4_substrate", "cyp2c9_substrate", "herg", "ames", "dili",
)


def soft_keys(nodes: np.ndarray, patterns: np.ndarray, thresholds: np.ndarray, sharpness: float = 10.0) -> np.ndarray:
    """Differentiable structural keys: each pattern's best match among atoms, through a sigmoid at its threshold."""
    if not len(nodes):
        return np.zeros(len(patterns))
    return sigmoid(sharpness * ((nodes @ patterns.T).max(0) - thresholds))


PROTEIN_LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def encode_protein(sequence: str, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(one-hot rows, mask) of a protein cut or padded to a length; an unknown residue is uniform."""
    x = one_hot(sequence[:length], PROTEIN_LETTERS)
    pad = length - len(x)
    return np.concatenate([x, np.zeros((pad, 20))]), np.concatenate([np.ones(len(x)), np.zeros(pad)])


def pair_affinity(sequence: str, drug: np.ndarray, params: dict, length: int = 64) -> float:
    """Score of a protein and a drug fingerprint: masked mean of a transformer block over residues, joined, dense net."""
    x, mask = encode_protein(sequence, length)
    y = transformer_block(x @ params["embed"], params["block"])
    protein = (y * mask[:, None]).sum(0) / max(mask.sum(), 1)
    return float(mlp(np.concatenate([protein, drug])[None], params["head"])[0, 0])


# Dynamics
def integrate(places: np.ndarray, velocities: np.ndarray, force, steps: int, dt: float = 0.005, mass: float = 1.0, mode: str = "velocity_verlet", temperature: float = 1.0, friction: float = 1.0, seed: int = 42) -> np.ndarray:
    """Trajectory (steps + 1, particles, dimensions), the start included: velocity Verlet, or Langevin at a temperature (BAOAB)."""
    if mode not in ("velocity_verlet", "nvt_langevin"):
        raise ValueError(f"unknown integrator {mode}")
    rng, x, v = np.random.default_rng(seed), places.astype(float).copy(), velocities.astype(float).copy()
    out, f = [x.copy()], force(places.astype(float))
    for _ in range(steps):
        v += dt / 2 * f / mass
        if mode == "velocity_verlet":
            x += dt * v
        else:
            x += dt / 2 * v
            keep = np.exp(-friction * dt)
            v = keep * v + np.sqrt((1 - keep**2) * temperature / mass) * rng.normal(size=v.shape)
            x += dt / 2 * v
        f = force(x)
        v += dt / 2 * f / mass
        out.append(x.copy())
    return np.array(out)


def lennard_jones_force(x: np.ndarray, sigma: float = 1.0, epsilon: float = 1.0) -> np.ndarray:
    d = x[:, None] - x[None]
    r2 = (d**2).sum(-1) + np.eye(len(x))
    s6 = (sigma**2 / r2) ** 3
    return ((24 * epsilon * (2 * s6**2 - s6) / r2 * (1 - np.eye(len(x))))[:, :, None] * d).sum(1)


# Training
def network_gradient(x: np.ndarray, y: np.ndarray, layers) -> tuple[float, list]:
    """(summed cross entropy, gradients) of a dense relu network with a softmax at its end; y are class codes."""
    held = [x]
    for k, (w, b) in enumerate(layers):
        z = held[-1] @ w + b
        held.append(relu(z) if k < len(layers) - 1 else z)
    p = softmax(held[-1])
    loss = float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).sum())
    p[np.arange(len(y)), y] -= 1
    out, delta = [], p
    for k in range(len(layers) - 1, -1, -1):
        out.append((held[k].T @ delta, delta.sum(0)))
        if k:
            delta = (delta @ layers[k][0].T) * (held[k] > 0)
    return loss, out[::-1]
