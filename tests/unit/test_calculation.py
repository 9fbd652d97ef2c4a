from veritab.sources import grids


def test_cells_are_dealt_once(spark):
    """Cells are exchanged by workbook, and by nothing else; the same cells are not read again."""
    rows = [("x", 1, 1, 1, "Origem"), ("x", 1, 1, 2, "Destino"), ("x", 1, 1, 3, "kVA"), ("x", 1, 2, 3, "7,5"), ("x", 1, 2, 1, "Q.P. A"), ("x", 1, 2, 2, "Pavilhão"), ("x", 1, 3, 1, "Q.P. A"), ("x", 2, 1, 1, "Origem")]
    cells = spark.createDataFrame(rows, "path string, sheet_no int, row int, col int, value string")
    r = grids.calc_rows(cells)
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == plan.count("Exchange hashpartitioning(path") == 1 and "Join" not in plan
    assert sorted(tuple(x) for x in grids.calc_values(r).collect()) == [("x", "ele.potencia_alimentar_kva", "7.5"), ("x", "ele.quadros", "Q.P. A")]
