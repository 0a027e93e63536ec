"""Plain versions of the operators, from their definitions alone: loops over whole lists, no Spark and nothing of the library's logic."""

import collections
import math
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def counts(t):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = t or ""
    w = words_of(t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(grams)
    covered = {k for i, g in enumerate(grams) if n[g] > 1 for k in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def shares(t):
    n, chars, symbols, dup, repeat = counts(t)
    w, t = words_of(t), t or ""
    lines = sum(1 for x in t.split("\n") if words_of(x))
    part = lambda a, b: round(a / b, 6) if b else 0.0
    upper = sum(1 for c in t if __import__("unicodedata").category(c) == "Lu")
    return [part(symbols, chars), part(upper, chars), part(len(re.findall("[!?]", t)), n), part(len(re.findall("[0-9]", t)), chars), part(repeat, n), part(dup, lines), part(len(set(w)), n), part(chars, n)]


def base_fails(t):
    n, _, _, _, repeat = counts(t)
    return n < 50 or 100 * repeat > 50 * n


def decision_list(samples, bins=24, most_rules=12, most_conditions=4, precision=0.97, cover=5):
    """Rules as lists of (feature, above, threshold) by sequential covering; samples are (shares, low quality, pruning third)."""
    def quantiles(values):
        v = sorted(values)
        return {v[max(math.ceil(i / bins * len(v)), 1) - 1] for i in range(1, bins)} if v else set()

    n_features = len(samples[0][0]) if samples else 0
    edges = [sorted(quantiles([s[0][f] for s in samples]) | quantiles([s[0][f] for s in samples if s[1]])) for f in range(n_features)]
    holds = lambda rule, x: all((x[f] > e) == above for f, above, e in rule)
    tally = lambda rule, part: (sum(1 for s in part if s[1] and holds(rule, s[0])), sum(1 for s in part if not s[1] and holds(rule, s[0])))
    rules = []
    while len(rules) < most_rules:
        grow, prune, rule = [s for s in samples if not s[2]], [s for s in samples if s[2]], []
        while len(rule) < most_conditions:
            p, n = tally(rule, grow)
            if not p or not n:
                break
            best, gain = None, 1e-9
            for f in range(n_features):
                for e in edges[f]:
                    for above in (True, False):
                        a, b = tally([*rule, (f, above, e)], grow)
                        if a >= cover and (g := a * (math.log2(a / (a + b)) - math.log2(p / (p + n)))) > gain:
                            best, gain = (f, above, e), g
            if best is None:
                break
            rule.append(best)

        def worth(r, prune=prune):
            p, n = tally(r, prune)
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        if not rule:
            break
        (p, n), (ap, an) = tally(rule, prune), tally(rule, samples)
        if ap < cover or ap < precision * (ap + an) or p < precision * (p + n):
            break
        rules.append(rule)
        samples = [s for s in samples if not holds(rule, s[0])]
    return rules


def rejects(rules, t):
    x = shares(t)
    return base_fails(t) or any(all((x[f] > e) == above for f, above, e in rule) for rule in rules)


def components(texts):
    """For each text the index of the first of its component, by all pairs of shingle sets."""
    sets = []
    for t in texts:
        w = words_of((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    return comp


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Target of each source, the excess shared again by weight until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        part = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = {s for s in open_ if part[s] > most * sizes[s]}
        if not full:
            return out | part
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= full
    return out
