"""Three query files over three small tagged tables, against exact output files."""
import pytest

from tabulon.plans.engine import run_query_file

#: The tables, the queries and what they must print.
TABLES = {
    "Employees": """Employees_id (N) (P),Name (T),Salary (N),JoinedDate (D)
1,Alice Johnson,70000.5,2023-01-15 08:45:00
2,Robert Smith,65800.75,2022-08-05 09:30:00
3,Emily Davis,80000,2021-11-20 03:15:00
4,Michael Brown,72000.25,2023-11-03 12:00:00
5,Jessica Williams,75000.9,2020-02-25 10:50:00
""",
    "Products": """Products_id (N) (P),ProductName (T),Price (N),ReleaseDate (D)
101,Widget A,20.99,2020-05-07 14:30:00
102,Gadget B,99.99,2021-04-22 16:10:00
103,Device C,15.5,2021-09-30 11:20:00
104,Equipment D,45.75,2022-05-15 09:45:00
105,Appliance E,30,2019-01-12 08:00:00
""",
    "SalesOrders": """Orders_id (N) (P),CustomerName (T),TotalAmount (N),OrderDate (D),Products_id (N),Employees_id (N)
1001,John Doe,150.45,2023-03-15 11:30:00,101,1
1002,Olivia Harris,275.99,2022-08-02 14:00:00,102,3
1003,William Johnson,95.75,2021-07-10 9:15:00,103,2
1004,Sophia Martinez,220,2020-11-21 16:45:00,104,4
1005,Liam Anderson,299.99,2019-07-14 10:00:00,105,5
1006,Harry Karl,195,2018-07-14 10:00:00,106,1
""",
}
QUERIES = {
    "one": ("SELECT AVG(e.Salary) AS AverageSalary\nFROM Employees e, SalesOrders s\nWHERE e.Employees_id = s.Employees_id\n  AND s.TotalAmount > 200;", "AverageSalary\n75667.050000\n"),
    "two": ("SELECT e.Name, (\n    SELECT SUM(s.TotalAmount)\n    FROM SalesOrders s\n    WHERE s.Employees_id = e.Employees_id\n) AS TotalSales\nFROM Employees e\nORDER BY TotalSales Desc;",
            "Name,TotalSales\nAlice Johnson,345.450000\nJessica Williams,299.990000\nEmily Davis,275.990000\nMichael Brown,220.000000\nRobert Smith,95.750000\n"),
    "three": ("SELECT p.ProductName, p.Price\nFROM Products p\nWHERE p.ReleaseDate > '2021-01-01 00:00:00'\nORDER BY p.Price Asc;", "ProductName,Price\nDevice C,15.500000\nEquipment D,45.750000\nGadget B,99.990000\n"),
}


@pytest.mark.parametrize("name", QUERIES)
def test_query_file_prints_the_golden_rows(spark, tmp_path, name):
    for t, text in TABLES.items():
        (tmp_path / f"{t}.csv").write_text(text)
    (tmp_path / f"{name}.txt").write_text(QUERIES[name][0])
    out = run_query_file(spark, str(tmp_path), str(tmp_path / f"{name}.txt"), str(tmp_path), "golden")
    assert out.endswith(f"golden_{name}.csv") and open(out).read() == QUERIES[name][1]
