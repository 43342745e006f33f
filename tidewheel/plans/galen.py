"""Six mutually recursive rules over an ontology's relations (p, q, r, c, u, s).

    p(x,z)   <- p(x,y), p(y,z)
    q(x,r,z) <- p(x,y), q(y,r,z)
    p(x,z)   <- p(y,w), u(w,r,z), q(x,r,y)
    p(x,z)   <- c(y,w,z), p(x,w), p(x,y)
    q(x,q,z) <- q(x,r,z), s(r,q)
    q(x,e,o) <- q(x,y,z), r(y,u,e), q(z,u,o)
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidewheel.operators.recursion import Relations, fixpoint


def _rename(df: DataFrame, *names: str) -> DataFrame:
    return df.toDF(*names)


def closure(p: DataFrame, q: DataFrame, r: DataFrame, c: DataFrame, u: DataFrame, s: DataFrame) -> Relations:
    """p and q at their least fixed point."""
    r3, c3, u3, s2 = _rename(r, "r1", "u", "e"), _rename(c, "y", "w", "z"), _rename(u, "w", "r", "z"), _rename(s, "r", "n")

    def derive(all_: Relations, new: Relations) -> Relations:
        P, dP, Q, dQ = all_["p"], new["p"], all_["q"], new["q"]  # noqa: N806
        ps: list[DataFrame] = []
        qs: list[DataFrame] = []
        for a, b in ((dP, P), (P, dP)):
            ps.append(_rename(a, "x", "y").join(_rename(b, "y", "z"), "y").select("x", "z"))
            ps.append(c3.join(_rename(a, "x", "w"), "w").join(_rename(b, "x", "y"), ["x", "y"]).select("x", "z"))
        for a, b in ((dP, Q), (P, dQ)):
            qs.append(_rename(a, "x", "y").join(_rename(b, "y", "r", "z"), "y").select("x", "r", "z"))
            ps.append(_rename(a, "y", "w").join(u3, "w").join(_rename(b, "x", "r", "y"), ["r", "y"]).select("x", "z"))
        qs.append(_rename(dQ, "x", "r", "z").join(s2, "r").select("x", "n", "z"))
        for a, b in ((dQ, Q), (Q, dQ)):
            qs.append(_rename(a, "x", "r1", "z").join(r3, "r1").join(_rename(b, "z", "u", "o"), ["z", "u"]).select("x", "e", "o"))
        out_p, out_q = _rename(ps[0], *P.columns), _rename(qs[0], *Q.columns)
        for d in ps[1:]:
            out_p = out_p.union(d)
        for d in qs[1:]:
            out_q = out_q.union(d)
        return {"p": out_p, "q": out_q}

    return fixpoint({"p": p, "q": q}, derive, compact_every=1)  # the rules read p and q a dozen times a round
