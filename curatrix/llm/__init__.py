"""Training-data operators.

Nothing else in the library imports this subpackage; ``queries`` in
``registry`` lists what it adds to the entry module.
"""

import os

# small matrices only: numeric libraries must not take more cores than a task has, nor must tokenizers
for _name, _value in (("OMP_NUM_THREADS", "1"), ("OPENBLAS_NUM_THREADS", "1"), ("MKL_NUM_THREADS", "1"), ("TOKENIZERS_PARALLELISM", "false")):
    os.environ.setdefault(_name, _value)
