"""sluice: Spark-native data work for multilingual text classification.

The most used pieces, importable from the package root::

    from sluice import build_session, clean_text, epoch_negatives, roc_auc
"""

from sluice.functions.hashing import gate, u32, uniform
from sluice.functions.labels import binarise, floor_below, one_hot, round_half_even
from sluice.functions.scoring import linear_head, softmax_pos, text_features
from sluice.functions.sequences import (attention_mask, pad_right, tokenize, truncate_head_tail,
                                        truncate_inner, truncate_right)
from sluice.functions.text import (clean_text, dedup_sentences, lang_name, split_sentences,
                                   squeeze_spaces, strip_hashtags, strip_mentions, strip_numbers,
                                   strip_urls)
from sluice.operators.augment import (augment_route, build_pool, shuffle_sentences, synthetic_mix,
                                      train_transforms)
from sluice.operators.labels import batch_count, label_counts, loss_weight
from sluice.operators.metrics import (average_meter, best_epoch, best_so_far, focal_loss,
                                      label_smoothing_loss, minmax_scale, pool_mean_max, roc_auc,
                                      running_auc, running_loss, weighted_bce)
from sluice.operators.ranking import dense_index, smallest_n
from sluice.operators.sampling import (epoch_negatives, fixed_batches, sample_exact_n, shard_rows,
                                       shuffle_head, shuffle_rows, with_order)
from sluice.operators.scoring import (batch_score, ensemble_mean, fit_epochs, score_models,
                                      score_views, submission_join)
from sluice.operators.sequences import build_vocab, encode, length_buckets, trim_batch
from sluice.operators.sets import combine_train_valid, dedup_text, union_sources
from sluice.session import build_session, materialize

__all__ = [name for name in dir() if not name.startswith("_")]
