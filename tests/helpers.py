"""Small assays from matrices."""

from spectraloom.model import Assay, Study


def study(spark, matrix, obs, var=None, name="psm", decoy=None, **more):
    """matrix: rows of samples, None is missing; obs: dicts with obs_id; var: dicts with var_id."""
    n = len(matrix[0])
    var = var or [{"var_id": f"v{j + 1}"} for j in range(n)]
    x = [(o["obs_id"], v["var_id"], float(matrix[i][j])) for i, o in enumerate(obs) for j, v in enumerate(var) if matrix[i][j] is not None]
    frame = lambda rows, order: spark.createDataFrame([{**r, order: k} for k, r in enumerate(rows)])
    assay = Assay(spark.createDataFrame(x, "obs_id string, var_id string, value double"), frame(var, "var_ord"), frame(decoy, "var_ord") if decoy else None, more.pop("level", name), **more)
    return Study({name: assay}, frame(obs, "obs_ord"))


def values(df):
    """{(obs_id, var_id): value}"""
    return {(r.obs_id, r.var_id): r.value for r in df.collect()}


def near(a, b, tolerance=1e-9):
    return (a is None and b is None) or (a is not None and b is not None and abs(a - b) <= tolerance)
