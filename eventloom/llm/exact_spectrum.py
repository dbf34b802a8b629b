"""The spectrum of an integer scatter matrix, exactly: characteristic polynomial by modular Hessenberg reduction and Chinese
remaindering, isolation of its real roots, and null-space inverse iteration for the eigenvectors.

All sizes here depend on the dimension alone, never on how many rows were summed. Primes and eigenvalues are rows of Spark tables.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

#: Relative precision of a root, bits in which roots that agree count as one, and fraction bits of the inverse iteration.
ROOT_BITS, EQUAL_BITS, WORK_BITS = 200, 140, 480


def is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide every n below 3.4e14."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7, 11, 13, 17)):
        return n in (2, 3, 5, 7, 11, 13, 17)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7, 11, 13, 17):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_for(bits: int) -> list[int]:
    """Primes under 2^31, so that products of residues fit 64 bits, whose product has more than `bits` bits."""
    found, product, p = [], 1, (1 << 31) - 1
    while product.bit_length() <= bits + 1:
        if is_prime(p):
            found.append(p)
            product *= p
        p -= 2
    return found


def residues(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(x I - matrix) modulo p, the highest first, from the Hessenberg form modulo p."""
    h = (matrix % p).astype(np.int64)
    d = len(h)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        i = m + int(below[0])
        if i != m:
            h[[i, m]] = h[[m, i]]
            h[:, [i, m]] = h[:, [m, i]]
        u = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :, m - 1 :] = (h[m + 1 :, m - 1 :] - u[:, None] * h[m, m - 1 :] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * u % p).sum(1)) % p
    # poly[k]: characteristic polynomial of the leading k x k block, lowest coefficient first
    poly = np.zeros((d + 1, d + 1), np.int64)
    poly[0, 0] = 1
    for k in range(1, d + 1):
        poly[k, 1:] = poly[k - 1, :-1]
        poly[k] = (poly[k] - h[k - 1, k - 1] * poly[k - 1]) % p
        factor, run = np.zeros(k - 1, np.int64), 1
        for i in range(k - 1, 0, -1):
            run = run * int(h[i, i - 1]) % p
            factor[i - 1] = run * int(h[i - 1, k - 1]) % p
        poly[k] = (poly[k] - (factor[:, None] * poly[: k - 1] % p).sum(0)) % p
    return poly[d, ::-1].tolist()


def characteristic(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """e_0 .. e_d of det(x I - M) = sum of (-1)^k e_k x^(d-k) for a positive semidefinite integer matrix: every e_k >= 0."""
    d, trace = len(matrix), sum(int(matrix[i, i]) for i in range(len(matrix)))
    # Maclaurin: e_k <= C(d, k) (trace / d)^k
    bits = max(math.comb(d, k).bit_length() + k * max(0, (-(-trace // d)).bit_length()) for k in range(d + 1))
    primes = primes_for(bits)

    def reduce(parts):
        for part in parts:
            yield pd.DataFrame({"p": part["p"], "r": [residues(matrix, int(p)) for p in part["p"]]})

    table = spark.createDataFrame(pd.DataFrame({"p": primes})).repartition(min(len(primes), spark.sparkContext.defaultParallelism))
    rows = table.mapInPandas(reduce, "p long, r array<long>").collect()  # bits / 30 rows of d + 1 values
    product = math.prod(r["p"] for r in rows)
    weights = [(product // r["p"]) * pow(product // r["p"] % r["p"], -1, r["p"]) for r in rows]
    return [sum(w * (r["r"][k] * (-1) ** k % r["p"]) for w, r in zip(weights, rows, strict=True)) % product for k in range(d + 1)]


class Roots:
    """Positive roots of the polynomial with alternating coefficients e, all of whose roots are real and not negative.

    For such polynomials Descartes' rule is exact: the sign changes of p(x + a) are the roots above a, with multiplicity.
    """

    def __init__(self, e: list[int]):
        self.rank = max(k for k in range(len(e)) if e[k])
        self.c = [(-1) ** k * e[k] for k in range(self.rank + 1)]  # roots 0 divided out, highest first

    def scaled(self, q: int) -> list[int]:
        """The polynomial whose roots are 2^q times as large."""
        return [c << (q * k) for k, c in enumerate(self.c)]

    def above(self, m: int, q: int) -> int:
        """How many roots exceed m / 2^q."""
        c = self.scaled(q)
        n = len(c) - 1
        for end in range(n, 0, -1):
            for i in range(1, end + 1):
                c[i] += m * c[i - 1]
        signs = [x > 0 for x in c if x]
        return sum(a != b for a, b in zip(signs, signs[1:], strict=False))

    def sign(self, m: int, q: int) -> int:
        v = 0
        for c in self.scaled(q):
            v = v * m + c
        return (v > 0) - (v < 0)

    def largest(self, wanted: int) -> list[tuple[int, int, int]]:
        """(m, q, multiplicity): the largest roots m / 2^q, falling, until `wanted` are counted with multiplicity."""
        out, counted = [], 0
        # the sum of the roots bounds the largest; strips from high to low
        strips = [(0, 1 << ((-self.c[1]).bit_length() + 1), 0, self.rank, 0)]
        while strips and counted < min(wanted, self.rank):
            lo, hi, q, v_lo, v_hi = strips.pop()
            n = v_lo - v_hi
            if n == 0:
                continue
            if lo and n == 1:
                m, q = self.refined(lo, hi, q)
                out.append((m, q, 1))
                counted += 1
            elif lo and (hi - lo) << EQUAL_BITS <= lo:
                out.append((lo + hi, q + 1, n))
                counted += n
            else:
                mid, q2 = lo + hi, q + 1
                v = self.above(mid, q2)
                strips += [(2 * lo, mid, q2, v_lo, v), (mid, 2 * hi, q2, v, v_hi)]
        return out

    def refined(self, lo: int, hi: int, q: int) -> tuple[int, int]:
        """The only root in (lo, hi] / 2^q, to ROOT_BITS."""
        top = self.sign(hi, q)
        if top == 0:
            return hi, q
        while (hi - lo) << ROOT_BITS > lo:
            mid, q = lo + hi, q + 1
            lo, hi = 2 * lo, 2 * hi
            s = self.sign(mid, q)
            if s == 0:
                return mid, q
            lo, hi = (lo, mid) if s == top else (mid, hi)
        return lo + hi, q + 1


def eigenvectors(matrix: np.ndarray, m: int, q: int, multiplicity: int) -> np.ndarray:
    """Orthonormal eigenvectors (columns) for the root m / 2^q, by elimination with complete pivoting in fixed point.

    The last `multiplicity` pivots vanish up to the root's error. Setting them aside gives the null space by back-substitution;
    inverse iteration on the same factors, with those pivots at a small value, then removes what the error left in it.
    """
    d, one = len(matrix), 1 << WORK_BITS
    scale = max(1, max(abs(int(x)) for x in matrix.ravel()))
    root = (m << WORK_BITS) // (scale << q)
    a = np.array([[(int(x) << WORK_BITS) // scale for x in row] for row in matrix], object)
    for i in range(d):
        a[i, i] -= root
    rows, cols = np.arange(d), np.arange(d)
    r = d - multiplicity
    for k in range(r):
        i, j = divmod(int(np.argmax(np.abs(a[k:, k:]))), d - k)
        if a[k + i, k + j] == 0:
            r = k
            break
        a[[k, k + i]], rows[[k, k + i]] = a[[k + i, k]], rows[[k + i, k]]
        a[:, [k, k + j]], cols[[k, k + j]] = a[:, [k + j, k]], cols[[k + j, k]]
        f = (a[k + 1 :, k] << WORK_BITS) // a[k, k]
        a[k + 1 :, k + 1 :] -= (f[:, None] * a[k, k + 1 :][None, :]) >> WORK_BITS
        a[k + 1 :, k] = f
    small = one >> (EQUAL_BITS + 20)

    def back(y: np.ndarray) -> np.ndarray:
        """x with U x = y, where y's last entries are x's own."""
        x = y.copy()
        for k in range(r - 1, -1, -1):
            x[k] = ((y[k] - (int((a[k, k + 1 :] * x[k + 1 :]).sum()) >> WORK_BITS)) << WORK_BITS) // a[k, k]
        out = np.zeros(d, object)
        out[cols] = x
        return out

    def orthonormal(vectors: list[np.ndarray]) -> list[np.ndarray]:
        done: list[np.ndarray] = []
        for v in vectors:
            top = max(1, max(abs(int(x)) for x in v))
            v = np.array([(int(x) << WORK_BITS) // top for x in v], object)
            for u in [*done, *done]:
                v = v - ((u * ((int((u * v).sum())) >> WORK_BITS)) >> WORK_BITS)
            norm = max(1, math.isqrt(int((v * v).sum())))
            done.append(np.array([(int(x) << WORK_BITS) // norm for x in v], object))
        return done

    free = []
    for j in range(r, d):
        y = np.zeros(d, object)
        y[:] = 0
        y[j] = one
        free.append(back(y))
    basis = orthonormal(free)
    for _ in range(2):
        solved = []
        for v in basis:
            y = v[rows].copy()
            for k in range(r):
                y[k + 1 :] -= (a[k + 1 :, k] * y[k]) >> WORK_BITS
            y[r:] = (y[r:] << WORK_BITS) // small
            solved.append(back(y))
        basis = orthonormal(solved)
    out = np.array([[int(x) / one for x in v] for v in basis]).T[:, :multiplicity]
    return out * np.where(out[np.abs(out).argmax(0), np.arange(out.shape[1])] < 0, -1.0, 1.0)


def leading_components(spark: SparkSession, matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(eigenvectors as columns, eigenvalues as pairs m, q for m / 2^q) of the largest positive eigenvalues, falling, at most `wanted`."""
    roots = Roots(characteristic(spark, matrix)).largest(wanted)

    def solve(parts):
        for part in parts:
            found = [eigenvectors(matrix, int(m), int(q), int(n)) for m, q, n in zip(part["m"], part["q"], part["n"], strict=True)]
            yield pd.DataFrame({"i": part["i"], "v": [v.T.ravel().tolist() for v in found]})

    table = spark.createDataFrame([(i, str(m), q, n) for i, (m, q, n) in enumerate(roots)], "i int, m string, q int, n int")
    rows = table.repartition(len(roots), "i").mapInPandas(solve, "i int, v array<double>").collect()  # at most `wanted` distinct roots
    by = {r["i"]: np.array(r["v"]).reshape(-1, len(matrix)) for r in rows}
    vectors = np.concatenate([by[i] for i in range(len(roots))]).T[:, :wanted]
    values = [(m, q) for m, q, n in roots for _ in range(n)][:wanted]
    return vectors, values
