from tests.test_shipping import run_elsewhere


def test_operators_run_without_the_package_on_the_path(tmp_path):
    names = ["op6_jpeg_media", "op1_token_counts", "op3_simhash", "op8_bpe"]
    assert run_elsewhere(tmp_path, names)[0::2] == names
