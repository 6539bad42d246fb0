"""The command line on small files."""

import pytest

from loomtext.plans import cli

ICE = ["###/###", *(f"{s}/{t}" for s, t in zip("3213", "HHCH", strict=True)), "###/###", *(f"{s}/{t}" for s, t in zip("1122", "CCCC", strict=True)), "###/###"]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("cli")
    (d / "train").write_text("".join(f"{a},{b},{'yes' if a == 'x' else 'no'}\n" for a in "xy" for b in "pqr"))
    (d / "new").write_text("x,p,yes\ny,q,no\n")
    (d / "out").write_text("yes 0.9 no 0.1\nyes 0.6 no 0.4\n")
    (d / "tagged").write_text("\n".join(ICE) + "\n")
    (d / "raw").write_text("3\n3\n###\n1\n")
    (d / "points").write_text("".join(f"name {i} {x} {y}\n" for i, (x, y) in enumerate([(0, 0), (0, 1), (9, 9), (9, 8)])))
    (d / "lex").write_text("zog := np\nruns := s\\np\n")
    (d / "bed").write_text("zog runs\n*runs zog\n")
    return {p.name: str(p) for p in d.iterdir()}


@pytest.mark.parametrize("method", ["nb", "perceptron", "pa-perceptron"])
def test_classify(spark, files, capsys, method):
    cli.main(["classify", "--train", files["train"], "--predict", files["new"], "--method", method])
    assert [line.split()[0] for line in capsys.readouterr().out.splitlines()] == ["yes", "no"]


def test_others(spark, files, capsys):
    cli.main(["score", files["new"], files["out"]])
    cli.main(["tag", "--train", files["tagged"], "--text", files["raw"], "--constrained"])
    cli.main(["cluster", files["points"], "-k", "2"])
    cli.main(["parse", files["lex"], files["bed"]])
    out = capsys.readouterr().out.splitlines()
    assert out[:5] == ["accuracy 50.00 (1/2)", "3/H", "3/H", "1/C", "dispersion 1.000000"] and sorted(out[-2:]) == ["SUCCESS runs zog", "SUCCESS zog runs"]
