"""A PySpark library for learning and analysing word vectors by divide, train, merge and evaluate."""

import os

for _name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):  # many small systems run side by side
    os.environ.setdefault(_name, "1")
