"""Small sources in three languages, with known parts."""

JAVA = '''package a.b;
import java.util.List;

/**
 * Serves users.
 */
@RestController
@RequestMapping("/api/users")
public class UserController extends BaseController implements Auditable, Closeable<String> {
    @Autowired
    private UserService userService;

    public UserController(UserRepo repo, final List<User> users) {
        this.repo = repo;
        init();
    }

    /** Finds { one. */
    @GetMapping("/{id}")
    public User find(@PathVariable String id,
                     int depth) {
        // not a call(x) {
        if (depth > 1) {
            return userService.find(id, "text { call(");
        } else {
            log.info("x");
        }
        return new User(id);
    }

    abstract void nothing(int a);
}

interface Store extends A, B {
    void save(Item item);
}
'''

TS = '''import { x } from 'y';
import express from 'express';

const app = express();

/** Loads all. */
export async function load(id: string, opts?: Opts): Promise<void> {
  const r = await fetch(`/api/users/${id}`);
  return api.post('/users/list');
}

export const Card: React.FC<CardProps> = ({ title }) => {
  return (
    <div>{title}</div>
  );
};

const handler = (req, res) => res.send(make(1));
app.get('/things/:id', auth, handler);

type Alias = { a: string };

@Controller('cats')
export class CatsController extends Base<Cat> implements OnInit {
  constructor(private readonly svc: CatsService) {}

  @Get(':id')
  async findOne(id: string) {
    if (id) { this.svc.findOne(id).then(x => x); }
    return new Cat(id);
  }
}
interface Shape extends Other { area(): number; }
'''

PY = '''import os
from a import b

@app.get("/items/{id}")
def read(id: int, q=None) -> str:
    """Read one."""
    def inner():
        return helper(q)
    return svc.load(id).run()

@deco
class Foo(Base, abc.ABC, Generic[T], object):
    """Doc."""
    async def m(self):
        self.go()

def test_read():
    assert read(1)
'''
