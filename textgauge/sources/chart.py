"""A radar chart of a text's dimensions as an SVG file."""

from __future__ import annotations

import math
import os
from xml.sax.saxutils import escape

SIZE, RADIUS = 640, 220


def _point(place: int, n: int, score: float) -> tuple[float, float]:
    angle = 2 * math.pi * place / n - math.pi / 2  # clockwise from the top
    return SIZE / 2 + RADIUS * score * math.cos(angle), SIZE / 2 + RADIUS * score * math.sin(angle)


def _ring(n: int, scores: list[float]) -> str:
    return " ".join(f"{x:.1f},{y:.1f}" for x, y in (_point(i, n, s) for i, s in enumerate(scores)))


def radar(dimensions: list[tuple[str, float]], title: str = "Dimensions") -> str:
    n = len(dimensions)
    lines = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{SIZE}" height="{SIZE}" font-family="sans-serif">', '<rect width="100%" height="100%" fill="white"/>']
    lines += [f'<polygon points="{_ring(n, [level] * n)}" fill="none" stroke="#ddd"/>' for level in (0.2, 0.4, 0.6, 0.8, 1.0)]
    for i, (name, score) in enumerate(dimensions):
        (x, y), (far_x, far_y) = _point(i, n, 1.0), _point(i, n, 1.15)
        lines.append(f'<line x1="{SIZE / 2}" y1="{SIZE / 2}" x2="{x:.1f}" y2="{y:.1f}" stroke="#ddd"/>')
        lines.append(f'<text x="{far_x:.1f}" y="{far_y:.1f}" font-size="12" text-anchor="middle">{escape(name)} {score:.2f}</text>')
    lines.append(f'<polygon points="{_ring(n, [s for _, s in dimensions])}" fill="#2a6f97" fill-opacity="0.25" stroke="#2a6f97" stroke-width="2"/>')
    lines.append(f'<text x="{SIZE / 2}" y="28" font-size="16" text-anchor="middle">{escape(title)}</text>')
    return "\n".join([*lines, "</svg>"])


def write_radar(dimensions: list[tuple[str, float]], path: str) -> str:
    """Writes the chart; returns its absolute path."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(radar(dimensions))
    return os.path.abspath(path)
