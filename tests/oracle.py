"""Trade-by-trade versions of the sequential bars, written from their definitions."""

from __future__ import annotations


def signs(prices):
    out, last = [], 1
    for k, p in enumerate(prices):
        if k and p != prices[k - 1]:
            last = 1 if p > prices[k - 1] else -1
        out.append(last)
    return out


def fixed(values, threshold, carry=0.0):
    ids, bar, c = [], 0, carry
    for v in values:
        ids.append(bar)
        c += v
        if c >= threshold:
            c -= threshold
            bar += 1
    return ids


def dynamic(values, days, thresholds, initial):
    ids, used, bar, c, th, day = [], [], 0, 0.0, initial, days[0]
    for v, d in zip(values, days, strict=True):
        if d != day:
            day, th = d, thresholds[d]
        ids.append(bar)
        used.append(th)
        c += v
        if c >= th:
            c -= th
            bar += 1
    return ids, used


def strange_mean(values, window):
    if not values:
        return 0.0
    m, w, q = values[0], 1.0, 1 - 2 / (window + 1)
    for i in range(1, len(values)):
        w += q**i
        m = m * q + values[i]
        if i < window:
            m /= 1 + q * w / (w + 1)
    return m


def imbalance(prices, quotes, init, prev, window, dollars):
    """(bar, theta, reported) of each bar: list of (trades, theta, expected)."""
    s = signs(prices)
    ticks, factor = init, 0.01
    value = 1.0
    if dollars:
        value = sum(quotes[:1000]) / 1000 if len(quotes) > 1000 else quotes[0]
    threshold = ticks * factor * value
    bars, n, theta, lengths = [], 0, 0.0, []
    for k in range(len(s)):
        n += 1
        theta += s[k] * (quotes[k] if dollars else 1)
        if abs(theta) >= threshold:
            bars.append((n, theta, threshold))
            lengths.append(n)
            if len(lengths) > 1:
                w = min(window, len(lengths))
                ticks = max(strange_mean(lengths[-w:], w), 0.1 * init)
            if k + 1 > 10:
                m = max(10, min(int(prev * ticks), k + 1))
                p = min(0.9, max(0.1, sum(x == 1 for x in s[k + 1 - m : k + 1]) / m))
                factor = max(abs(2 * p - 1), 0.01)
                if dollars:
                    value = strange_mean(quotes[k + 1 - m : k + 1], min(20, m))
            threshold, theta, n = ticks * factor * value, 0.0, 0
    if n:
        bars.append((n, theta, bars[-1][2] if bars else ticks * 0.01 * value))
    return bars
