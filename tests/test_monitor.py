import logging

import pytest

from rowlens import __version__, monitor


def test_timer_memory_and_progress(caplog):
    caplog.set_level(logging.INFO, "rowlens")
    with pytest.raises(KeyError), monitor.timer("work") as t:
        raise KeyError
    assert t.seconds >= 0 and "work took" in caplog.text
    with monitor.memory_use(warn_mb=-1e9) as m:
        pass
    assert m.before_mb > 0 and "memory grew" in caplog.text
    assert list(monitor.progress(range(5), 5, 2)) == [0, 1, 2, 3, 4]
    assert "4 items (80 %)" in caplog.text and "5 items (100 %)" in caplog.text
    assert __version__
