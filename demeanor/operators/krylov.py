"""Iterative solvers over NumPy vectors of coefficients; operators are callables."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum

import numpy as np

from ..errors import ConfigError

Apply = Callable[[np.ndarray], np.ndarray]
EPS = float(np.finfo(float).eps)


class StopReason(Enum):
    """Why a solver ended."""

    ZeroRhs = "zero right-hand side"
    OrthogonalRhs = "orthogonal right-hand side"
    Tolerance = "tolerance"
    Residual = "residual"
    NormalEquations = "normal equations"
    ClosedForm = "closed form"
    Iterations = "iterations"
    Stagnation = "stagnation"
    NoDescent = "no descent"
    NotFinite = "response is not finite"


@dataclass
class Outcome:
    x: np.ndarray
    converged: bool
    iterations: int
    residual: float
    reason: StopReason


def cg(a: Apply, b: np.ndarray, m: Apply | None = None, tol: float = 1e-8, maxiter: int = 1000) -> Outcome:
    """Preconditioned conjugate gradients for a symmetric positive semidefinite system."""
    m = m or (lambda v: v.copy())
    scale = float(np.linalg.norm(b))
    x = np.zeros_like(b)
    if scale < EPS:
        return Outcome(x, True, 0, 0.0, StopReason.ZeroRhs)
    r = b.copy()
    z = m(r)
    p = z.copy()
    rz = first = float(r @ z)
    for k in range(1, maxiter + 1):
        ap = a(p)
        curve = float(p @ ap)
        if not curve > 0:
            return Outcome(x, False, k, float(np.linalg.norm(r)) / scale, StopReason.NoDescent)
        step = rz / curve
        x += step * p
        r -= step * ap
        left = float(np.linalg.norm(r)) / scale
        if left <= tol:
            return Outcome(x, True, k, left, StopReason.Tolerance)
        z = m(r)
        new = float(r @ z)
        if abs(new) < EPS**2 * max(abs(first), np.finfo(float).tiny):
            return Outcome(x, False, k, left, StopReason.Stagnation)
        p = z + (new / rz) * p
        rz = new
    return Outcome(x, False, maxiter, float(np.linalg.norm(r)) / scale, StopReason.Iterations)


def gmres(a: Apply, b: np.ndarray, m: Apply | None = None, tol: float = 1e-8, maxiter: int = 1000, restart: int = 30) -> Outcome:
    """Restarted GMRES, preconditioned on the right."""
    m = m or (lambda v: v.copy())
    scale = float(np.linalg.norm(b))
    x = np.zeros_like(b)
    if scale < EPS:
        return Outcome(x, True, 0, 0.0, StopReason.ZeroRhs)
    done, restart = 0, max(1, min(restart, len(b)))
    while True:
        r = b - a(x)
        norm = float(np.linalg.norm(r))
        if norm <= tol * scale or done >= maxiter:
            return Outcome(x, norm <= tol * scale, done, norm / scale, StopReason.Tolerance if norm <= tol * scale else StopReason.Iterations)
        basis, steps = [r / norm], []
        h = np.zeros((restart + 1, restart))
        turns: list[tuple[float, float]] = []
        g = np.zeros(restart + 1)
        g[0], size, ended = norm, 0, False
        while size < restart and done < maxiter and not ended:
            j = size
            steps.append(m(basis[j]))
            w = a(steps[j])
            for i, v in enumerate(basis):
                h[i, j] = float(v @ w)
                w = w - h[i, j] * v
            tail = float(np.linalg.norm(w))
            top = float(np.abs(h[: j + 1, j]).max())
            for i, (c, s) in enumerate(turns):
                h[i, j], h[i + 1, j] = c * h[i, j] + s * h[i + 1, j], c * h[i + 1, j] - s * h[i, j]
            size, done = size + 1, done + 1
            ended = tail <= 1e-14 * max(top, tail)
            length = float(np.hypot(h[j, j], tail))
            c, s = (h[j, j] / length, tail / length) if length else (1.0, 0.0)
            turns.append((c, s))
            h[j, j] = length
            g[j], g[j + 1] = c * g[j], -s * g[j]
            if not ended:
                basis.append(w / tail)
            ended = ended or abs(g[j + 1]) <= tol * scale
        y = np.zeros(size)
        for i in reversed(range(size)):
            pivot = h[i, i]
            y[i] = (g[i] - h[i, i + 1 : size] @ y[i + 1 :]) / pivot if abs(pivot) > EPS * max(1.0, norm) * 1e-2 else 0.0
        old = x
        x = x + sum(c * v for c, v in zip(y, steps))
        if float(np.linalg.norm(x - old)) == 0.0:
            return Outcome(x, False, done, float(np.linalg.norm(b - a(x))) / scale, StopReason.Stagnation)


def lsmr(a: Apply, at: Apply, b: np.ndarray, m: Apply | None = None, tol: float = 1e-8, maxiter: int = 1000, local_size: int | None = None, extra: float = 0.0) -> Outcome:
    """LSMR for min |b - A x|, with a symmetric preconditioner of A'A.

    ``extra``: squared length of a part of b that no x reaches, left out of ``b``; it counts in the
    stopping rules. ``local_size``: so many earlier directions are kept orthogonal. ``b`` and what ``a``
    returns are arrays, or vectors with ``length()`` that can be scaled and subtracted.
    """
    if not np.isfinite(tol) or tol < 0:
        raise ConfigError("tol must be finite and not negative")
    length = (lambda v: float(np.linalg.norm(v))) if isinstance(b, np.ndarray) else (lambda v: v.length())
    beta = length(b)
    if not np.isfinite(beta):
        raise ConfigError("the right-hand side must be finite")
    m = m or (lambda v: v.copy())
    if beta == 0.0:
        return Outcome(np.zeros_like(at(b)), True, 0, 0.0, StopReason.ZeroRhs)
    whole = float(np.sqrt(beta**2 + extra))
    u = b / beta
    p = at(u)
    v = m(p)
    alpha = float(np.sqrt(max(v @ p, 0.0)))
    x = np.zeros_like(v)
    if alpha == 0.0:
        return Outcome(x, True, 0, 0.0, StopReason.OrthogonalRhs)
    v, p = v / alpha, p / alpha
    near: deque = deque([(v, p)], maxlen=local_size) if local_size else deque(maxlen=0)
    zetabar, alphabar, rho, rhobar, cbar, sbar = alpha * beta, alpha, 1.0, 1.0, 1.0, 0.0
    h, hbar = v.copy(), np.zeros_like(v)
    betadd, betad, rhodold, tautilde, thetatilde, zeta, d = beta, 0.0, 1.0, 0.0, 0.0, 0.0, extra
    norm_a2 = alpha**2
    for k in range(1, maxiter + 1):
        u = a(v) - alpha * u
        beta = length(u)
        if beta > 0:
            u = u / beta
            p = at(u) - beta * p
            v = m(p)
            for q, mq in near:
                c = float(v @ mq)
                v, p = v - c * q, p - c * mq
            alpha = float(np.sqrt(max(v @ p, 0.0)))
            if alpha > 0:
                v, p = v / alpha, p / alpha
                near.append((v, p))
        else:
            alpha = 0.0
        rhoold = rho
        rho = float(np.hypot(alphabar, beta))
        c, s = alphabar / rho, beta / rho
        theta, alphabar = s * alpha, c * alpha
        rhobarold, zetaold, thetabar = rhobar, zeta, sbar * rho
        rhotemp = cbar * rho
        rhobar = float(np.hypot(rhotemp, theta))
        cbar, sbar = rhotemp / rhobar, theta / rhobar
        zeta, zetabar = cbar * zetabar, -sbar * zetabar
        hbar = h - (thetabar * rho / (rhoold * rhobarold)) * hbar
        x = x + (zeta / (rho * rhobar)) * hbar
        h = v - (theta / rho) * h
        betaacute, betahat = betadd, c * betadd
        betadd = -s * betaacute
        thetatildeold = thetatilde
        rhotildeold = float(np.hypot(rhodold, thetabar))
        ct, st = rhodold / rhotildeold, thetabar / rhotildeold
        thetatilde, rhodold = st * rhobar, ct * rhobar
        betad = -st * betad + ct * betahat
        tautilde = (zetaold - thetatildeold * tautilde) / rhotildeold
        taud = (zeta - thetatilde * tautilde) / rhodold
        res = float(np.sqrt(d + (betad - taud) ** 2 + betadd**2))
        norm_a2 += beta**2 + alpha**2
        normal = abs(zetabar) / max(np.sqrt(norm_a2) * res, np.finfo(float).tiny)
        if res <= tol * whole or normal <= tol or alpha == 0.0:
            return Outcome(x, True, k, normal, StopReason.Residual if res <= tol * whole else StopReason.NormalEquations)
    return Outcome(x, False, maxiter, abs(zetabar), StopReason.Iterations)
